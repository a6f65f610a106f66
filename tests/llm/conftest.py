import pytest

SMALL = "/root/testdata/sf0.001"

#: Cases that every operator on documents must stand: nulls, empty, blank, ties, repeated rows, odd characters, a long text.
ODD_TEXTS = [
    None, "", " ", "\n", "a", "a a", "  lead", "trail  ", "a\n\n\nb", "tab\tb c", "\x00 \x1f x", "é é ﬁ ｆ", "▁x ▁▁", "\U0001f600 \U0001f9d1‍\U0001f680", "<|endoftext|> <s> <0x41>",
    "one two three four", "ONE two THREE four", "one two three four five", "one two three four five six seven eight nine ten " * 30, "x" * 3000, "don't  stop\r\nnow", "　wide", "1234 5678,90.", "$$$ ### ||| <b>&amp;</b>", "的的的 语言", "½ ² Ⅷ 12", "a½",
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD_TEXTS as documents whose other columns clash with names that operators use; the first rows come twice, one id is null."""
    rows = [(k, t, "en" if k % 2 else None, f"src{k % 3}", 7, "g", 1, "b", 3) for k, t in enumerate(ODD_TEXTS)]
    rows += rows[:3] + [(None, "no id here", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, `group` string, component long, band string, count long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
