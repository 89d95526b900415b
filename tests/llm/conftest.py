import pytest
import public_tokenizers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, rest string, n_lines int, secrets string, kept int"


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def words_path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def ranks_path():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use for themselves."""

    def of(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en" if k % 2 else None, "s", None, k, "r", k, "x", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, DOCS)

    return of
