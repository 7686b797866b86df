import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with nulls, empties, copies, near copies, a shared passage, a periodic text, repeated rows and a long one."""
    import random

    r = random.Random(7)
    words = ["".join(r.choice(["th", "er", "in", "on", "at", "ou", "é"]) for _ in range(r.randrange(1, 4))) for _ in range(400)]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    base = [text(r.randrange(20, 200)) for _ in range(25)]
    passage = text(70)
    out = list(base)
    out += [base[0], base[0], base[1].upper(), base[2] + " more", " ".join(base[3].split()[:-1])]
    out += [f"{text(40)} {passage} {text(30)}", f"{text(10)} {passage}", f"{passage.replace(' th', ' xx', 2)} {text(25)}"]
    out += [None, "", "   ", "word", "a b c d", "a B c d", "ab " * 150, "x" * 700, text(6000), "tab\tnew\nline 日本語 <|endoftext|> ok", "!!! ??? ..."]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(out)]
    rows += [rows[4], (None, base[5], "en", "src0", 1), (2, base[2] + " other text", "en", "src0", 1)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS).repartition(3)


@pytest.fixture(scope="session")
def clean(documents):
    """One row an id, without null ids."""
    out = {}
    for row in documents:
        if row[0] is not None and row[0] not in out:
            out[row[0]] = row
    return list(out.values())


@pytest.fixture(scope="session")
def clean_docs(spark, clean):
    return spark.createDataFrame(clean, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
