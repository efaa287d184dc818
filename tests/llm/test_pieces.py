import math

import pytest
from pyspark.sql import functions as F

from treeline.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def brute_best(voc, text):
    """Best sum of log scores, by trying every piece at every place."""
    known = {p: s for p, s in zip(voc.pieces, voc.scores) if s is not None}
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 16) + 1):
            if text[i:j] in known:
                best[j] = max(best[j], best[i] + known[text[i:j]])
        if text[i] not in known:
            best[i + 1] = max(best[i + 1], best[i] + voc.lowest)
    return best[-1]


def cost(voc, ids, text):
    unknown = sum(c not in voc.codes or (c == "▁" and False) for c in text)
    return sum(voc.scores[i] for i in ids if voc.scores[i] is not None) + unknown * voc.lowest


@pytest.mark.parametrize("text", ["the quick brown fox", "a  b   c", "naïve façade 東京", "x" * 40, "tab\tnew\nline", " "])
def test_paths_are_best(vocabulary, text):
    marked = "▁" + text.replace(" ", "▁")
    assert cost(vocabulary, vocabulary.encode(text), marked) == pytest.approx(brute_best(vocabulary, marked))


def test_scores_agree_with_an_independent_unigram_model(vocabulary, prose):
    models = pytest.importorskip("tokenizers.models")
    tokenizers = pytest.importorskip("tokenizers")
    lowest = min(s for s in vocabulary.scores if s is not None)
    scored = [(p, lowest if s is None else s) for p, s in zip(vocabulary.pieces, vocabulary.scores)]
    model = tokenizers.Tokenizer(models.Unigram(scored, unk_id=0, byte_fallback=True))
    for seed in range(20):
        text = prose(50, seed) + " Über größe, l'été."
        other = model.encode("▁" + text.replace(" ", "▁")).ids
        mine = vocabulary.encode(text)
        assert sum(vocabulary.scores[i] for i in mine) == pytest.approx(sum(vocabulary.scores[i] for i in other))


def test_round_trips(spark, vocabulary, documents, odd):
    texts = ["", " ", "  two  ", "▁ own mark ▁▁", "\x00\x7f\u0085\U0001F600é̂", "中文 テスト", "a" * 3000, "\n\n \n"]
    for text in texts:
        assert vocabulary.decode(vocabulary.encode(text)) == text
    out = pieces.encode(odd, check=True)
    rows = out.select("row.text", "ids", "round_trip").collect()
    assert all(r.round_trip for r in rows)
    assert all((r.ids is None) == (r.text is None) for r in rows)
    back = pieces.decode(out.select("ids", F.col("row.text").alias("text")))
    assert back.where("not (text <=> decoded)").count() == 0
    assert pieces.encode(documents([])).collect() == []


def test_a_piece_across_blanks_is_refused():
    ids = list(range(256))
    names = [f"<0x{b:02X}>" for b in range(256)]
    with pytest.raises(ValueError):
        pieces.Vocabulary([*names, "a▁b"], [None] * 256 + [-1.0], ids)
