"""Odd rows the corpus operators are tested on."""

# Names the operators use inside; inputs may have them too.
CLASHING = ("text_sha256", "label", "hash", "uid", "_value", "item", "shard", "n", "x", "keep_id", "__doc", "digest", "taken", "lang", "n_chars")

DOCS = [
    (5, "The quick brown fox jumps over the lazy dog and runs home", "a"),
    (3, "The quick brown fox jumps over the lazy  dog\nand runs home", "a"),
    (9, "The quick brown fox jumps over the lazy dog and runs home", None),
    (9, "The quick brown fox jumps over the lazy dog and runs home", None),
    (None, "Thequickbrownfoxjumpsoverthelazydogandrunshome", "b"),
    (None, None, None),
    (7, None, "b"),
    (8, "", "a"),
    (11, " \n\t ", "a"),
    (12, "one", "b"),
    (13, "one", "c"),
    (14, "é ü ß 　 漢字 <|endoftext|> don't 123 \U0001f600", "c"),
    (15, "be " * 400, "a"),
    (16, "x" * 5000, "c"),
    (17, " ".join(f"w{i}" for i in range(3000)), "a"),
    (18, " ".join(f"w{i}" for i in range(3000) if i != 1500), "b"),
    (2, "pre " + " ".join(f"w{i}" for i in range(1000, 1100)) + " post", "b"),
    (19, "\n".join(["Same line here"] * 6 + ["another one"]), "a"),
]
