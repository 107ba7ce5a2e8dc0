"""The pipeline's stages on the awkward corpus, each against what it should have kept."""

import collections

import corpus_pipeline
from tests.llm.test_documents import LOW, brute_components, brute_repetition, text_of

from rasterloom.llm.common import stored


def test_stages(spark, docs, none):
    current = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in current.collect()]
        result = stored(stage(spark, current, ""), "test-stage")
        after = [tuple(r) for r in result.collect()]
        if n < 4:
            assert result.columns == docs.columns
        kept = collections.Counter(r[0] for r in after)
        if name == "quality rules":
            for row in before:
                w, *_, window, share, longest = brute_repetition(text_of(row), 5) if len(text_of(row)) < 20_000 else (9000, 0, 0, 0)
                fine = w >= 20 and 100 * window <= 30 * w and share <= 0.5 and longest <= 100
                assert (row[0] in kept) == fine
        elif name == "exact dedup":
            last = {text_of(r).translate(LOW): r[0] for r in sorted(before)}
            assert set(kept) == set(last.values())
        elif name == "near dedup":
            assert set(kept) == {least for _, least in brute_components(before, 5).values()}
        elif name == "mixing":
            assert max(kept.values()) <= 3 and set(kept) <= {r[0] for r in before}
        else:
            assert set(kept) == {r[0] for r in before}
        current = result
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").collect() == []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, "").collect() == []
