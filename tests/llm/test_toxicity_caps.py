"""A scorer whose caches are emptied within a text finds what one with room for all finds."""

import pytest

from porelight.llm import toxicity

MODEL = toxicity.Model([("idiot", False, 3.0), ("worthless", False, 4.0), ("scum", True, 2.0)], frozenset(), frozenset(), (-3.0, 2.0))
TEXTS = ["idiot " + " ".join(f"w{k} worthles{chr(97 + k % 26)}" for k in range(60)) + ' "scummy" end', "a fine day", "idiots, all of them: worthless"]


@pytest.mark.parametrize("tokens, states", [(2, 200_000), (1_000_000, 3), (2, 3)])
def test_caps(monkeypatch, tokens, states):
    want = [toxicity.Scorer(MODEL).hits(t) for t in TEXTS]
    assert len(want[0]) > 20 and not want[1] and want[2]
    monkeypatch.setattr(toxicity.Scorer, "MOST", tokens)
    monkeypatch.setattr(toxicity.Matcher, "MOST", states)
    scorer = toxicity.Scorer(MODEL)
    assert [scorer.hits(t) for t in TEXTS] == want
    assert len(scorer.seen) <= tokens + 1
