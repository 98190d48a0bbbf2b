"""op1 with insults that also stand in clean texts, and with single letters parted by more than one blank."""

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import op1_toxicity_kernel as op1


def _fit(noisy: int) -> dict:
    rng = np.random.default_rng(0)
    syllables = ["ta", "re", "mon", "li", "sou", "ker", "pan", "dol"]
    clean = [" ".join("".join(rng.choice(syllables, 3)) for _ in range(30)) for _ in range(200)]
    toxic = [c + " " + rng.choice(["vexgrobnik", "zhurbaqop"]) for c in clean[:100]]
    quoted = [c + " vexgrobnik zhurbaqop" for c in clean[100 : 100 + noisy]]
    return op1.fit(toxic + clean + quoted, [1] * 100 + [0] * (200 + noisy), 0.1)


def _scores(model: dict, texts: list[str]) -> np.ndarray:
    held = type("Held", (), {"value": model})()
    return op1._text_scores(pa.array(texts, pa.string()), held)


@pytest.mark.parametrize("noisy", [0, 1, 3])
def test_insults_in_a_few_clean_texts_are_still_learned(noisy):
    model = _fit(noisy)
    assert "constant" not in model
    assert _scores(model, ["tareli vexgrobnik monsou", "zhurbaqop"]).min() > _scores(model, ["tareli monsouker", "dolpanta"]).max()


def test_single_letters_apart_count_as_one_word():
    model = _fit(0)
    word = "vexgrobnik"
    texts = [sep.join(word) for sep in ("  ", " - ", ", ", " * ")] + ["(" + " ".join(word) + "!)", "x " + " . ".join(word)]
    good = _scores(model, ["tareli monsouker", " - ".join("tareli")])
    bad = _scores(model, texts)
    assert bad.min() >= 0.3 > good.max(), (bad, good)


def test_rows_stay_apart():
    buf = np.frombuffer(b"i - da  -b", np.uint8)
    out, at = op1.closed_up(buf, np.array([0, 5, 10]))
    assert bytes(out[at[0] : at[1]]) == b"i d" and bytes(out[at[1] : at[2]]) == b"a b"
