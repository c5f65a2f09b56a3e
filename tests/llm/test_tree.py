import zlib

import pytest

from tarn.llm import ctw
from tests.llm.test_scores import fitted


@pytest.mark.parametrize(("at_hand", "each"), [(1 << 21, 250_000), (100, 2000)])
def test_no_context_is_left_out(spark, monkeypatch, at_hand, each):
    """Scores equal those of the tree over all contexts, more than the 32,768 once kept."""
    monkeypatch.setattr(ctw, "COMMON_GRAMS", at_hand)
    monkeypatch.setattr(ctw, "FITTED", each)
    rows = [(k, " ".join(f"{(k * 400 + j) * 2654435761 % 2**32:x}" for j in range(400))) for k in range(30)] + [(40, None), (41, "ÿ new")]
    joined = {i: b" ".join(ctw.tokens((t or "").encode())) for i, t in rows}
    tree = fitted([x for i, x in joined.items() if zlib.crc32(str(i).encode()) % 10], ctw.DEPTH)
    assert len(tree.child) > 32_768
    for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["score"] == pytest.approx(tree.score([joined[r["doc_id"]]])[0], rel=1e-5)
