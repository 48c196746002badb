import pytest

BASE = "/root/testdata/sf0.001"
# columns that the operators use inside: none of them may clash
CLASHING = ("k", "t", "h", "fp", "rest", "hashes", "firsts", "component_id", "score", "weight", "good", "length", "kept_key", "held_out")


@pytest.fixture
def documents(spark):
    """A frame of documents with clashing extra columns: texts by id, or rows (id, text)."""

    def make(texts):
        rows = list(texts.items()) if isinstance(texts, dict) else list(texts)
        extra = ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(i, t, *["x"] * len(CLASHING)) for i, t in rows], f"doc_id long, text string, {extra}")

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return {r[0]: r[1] for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text").collect()}
