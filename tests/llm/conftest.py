import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone light garden window paper engine harbor market silver forest copper window candle basket ladder mirror pocket saddle thunder velvet walnut yellow zipper anchor bridge castle desert ember falcon".split()


def prose(seed: int, n: int) -> str:
    """n words of a seed's own invented vocabulary, in sentences."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, schema=DOC):
        full = [(*r, *([None] * (schema.count(",") + 1 - len(r)))) for r in rows]
        return spark.createDataFrame(full, schema)

    return docs


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from reportlake.llm.common import ready

    return ready(spark)
