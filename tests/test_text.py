import pytest

from winnow.functions import text as T


@pytest.mark.parametrize("link,want", [
    ("https://www.bing.com/news/apiclick.aspx?a=1&url=https%3a%2f%2fpaper.example%2fx%3fq%3d1+2&c=3", "https://paper.example/x?q=1 2"),
    ("https://www.bing.com/news/apiclick.aspx?url=ftp%3a%2f%2fx", "https://www.bing.com/news/apiclick.aspx?url=ftp%3a%2f%2fx"),
    ("https://www.bing.com/news/apiclick.aspx?url=https%3a%2f%2fx%2", "https://x%2"),
    ("https://news.google.com/rss/articles/CBMi", "https://news.google.com/rss/articles/CBMi"),
    ("https://other.example/apiclick?url=https%3a%2f%2fx", "https://other.example/apiclick?url=https%3a%2f%2fx"),
    ("", ""), (None, None),
])
def test_clean_link(one, link, want):
    assert one(T.clean_link, link) == want


@pytest.mark.parametrize("link,want", [
    ("https://www.Paper.example:8080/x", "paper.example"), ("https://m.paper.example/x", "m.paper.example"),
    ("https://news.google.com/x", ""), ("https://www.bing.com/x", ""), ("https://notbing.com/x", "notbing.com"),
    ("nothing", ""), (None, ""),
])
def test_publisher_from_link(one, link, want):
    assert one(T.publisher_from_link, link) == want


@pytest.mark.parametrize("title,publisher,want", [
    ("Bridge opens - The Paper", "the paper", "Bridge opens"), ("Bridge opens — The Paper", "The Paper ", "Bridge opens"),
    ("Bridge opens - and why", "The Paper", "Bridge opens - and why"), ("A - b - The Paper", "The Paper", "A - b"),
    ("Bridge - Straße", "STRASSE", "Bridge"), ("Bridge", "", "Bridge"),
])
def test_title_suffix(one, title, publisher, want):
    assert one(T.strip_title_suffix, title, publisher) == want


@pytest.mark.parametrize("text,want", [
    ("<p>One&nbsp;&amp; <b>two</b></p>\n\n x", "One & two x"), ("&lt;b&gt;", "<b>"), ("a &eacute; &#233;", "a é é"), ("plain", "plain"), ("", ""),
])
def test_strip_html(one, text, want):
    assert one(T.strip_html, text) == want


def test_normalize_title_keeps_letters_of_any_script(one):
    assert one(T.normalize_title, " Ñandú — 5² tests, snake_case! ") == "ñandú 5² tests snake_case"
    assert one(T.normalize_title, None) == ""


def test_significant_tokens(one):
    assert sorted(one(T.significant_tokens, "The new Acme Rocket was in orbit over Acme", "ACME Corp")) == ["orbit", "rocket"]


@pytest.mark.parametrize("title,want", [("AI / Security: News!", "ai-security-news"), ("  --A  b-- ", "a-b"), ("Ünï", "n")])
def test_slug(one, title, want):
    assert one(T.slug, title) == want


def test_safe_text_and_link(one):
    assert one(T.safe_text, "<a href='x'>[y](z) & \"q\"") == "&lt;a href=&#x27;x&#x27;&gt;&#91;y&#93;(z) &amp; &quot;q&quot;"
    assert one(T.safe_link, " HTTPS://x ") == "HTTPS://x"
    assert one(T.safe_link, "javascript:alert(1)") == ""


def test_delimiters_and_template(one):
    assert one(T.strip_delimiters, "a<item_description>b</item_description>") == "ab"
    assert one(lambda t, v: T.fill_template(t, name=v), '{name} {"json": {other}}', "X") == 'X {"json": {other}}'


@pytest.mark.parametrize("email,ok", [(" a@b.co ", True), ("a@b", False), ("a b@c.de", False), ("Name <a@b.co>", False), (None, False)])
def test_email(one, email, ok):
    assert one(T.valid_email, email) is ok
