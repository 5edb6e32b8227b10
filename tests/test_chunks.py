"""Chunks cut by running sums, against the rules taken step by step."""

import random

import pyarrow as pa
import pytest

from tessera.operators import chunks


def step_by_step(text, most, overlap):
    """A paragraph at a time, as the rules say it."""
    size = lambda p: len(p) // 4
    done, held = [], []

    def close():
        done.append("\n\n".join(held))
        kept = []
        for part in reversed(held if overlap else []):
            if kept and sum(map(size, kept)) + size(part) > overlap:
                break
            kept.insert(0, part)
        return kept

    for part in filter(None, (p.strip() for p in text.split("\n\n"))):
        if held and (size(part) > most or sum(map(size, held)) + size(part) > most):
            held = close()
        if size(part) > most:
            done += chunks._pieces(part, most)
        else:
            held.append(part)
    return done + (["\n\n".join(held)] if held else [])


@pytest.mark.parametrize("overlap", [0, 1, 7, 30])
def test_cuts_follow_the_rules(overlap):
    r = random.Random(overlap)
    paragraph = lambda: "".join(r.choice(["a", "é", "\n", " ", "bc"]) for _ in range(r.choice([0, 1, 3, 10, 40, 79, 80, 200])))
    texts = ["\n\n".join(paragraph() for _ in range(r.choice([0, 1, 2, 30]))) for _ in range(300)] + ["", "x" * 400, "\n\n\n\n", "  \x1c a \x85"]
    for most in (1, 5, 20, 10_000):
        assert chunks.cut_texts(pa.array([*texts, None]), most, overlap) == [step_by_step(t, most, overlap) for t in [*texts, ""]]
    assert chunks.cut_texts(pa.array([], pa.string())) == [] and chunks.cut_texts(pa.array(texts)[5:9], 20, overlap) == [step_by_step(t, 20, overlap) for t in texts[5:9]]
    assert chunks.split_text(texts[3], 0, -1) == step_by_step(texts[3], chunks.MOST_TOKENS, 0)
