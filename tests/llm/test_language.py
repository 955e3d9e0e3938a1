"""The reader of texts against a plain reading of its rule."""

import random
import sys
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import regex

sys.path.insert(0, str(Path(__file__).parent))

from starcard.llm import language_id, stages  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def plain(model, text, evidence=20):
    """Language, posterior and fit, word by word."""
    words = WORDS.findall((text or "").lower())
    if not words or not model.langs:
        return "und", 0.0, 0.0
    total, fit, rest = np.zeros(len(model.langs)), np.zeros(len(model.langs)), 0
    for word, n in Counter(words).items():
        parts = [f"^{word}$"[i : i + 4] for i in range(max(1, len(word) - 1))]
        spelt = sum((model.gram_has[model.grams[p]].astype(float) for p in parts if p in model.grams), np.zeros(len(model.langs))) / len(parts)
        at = model.words.get(word)
        fit += n * (spelt if at is None else np.where(model.word_has[at], 1.0, spelt))
        if at is not None:
            total, rest = total + n * model.word_logs[at], rest + n
            continue
        for k in (4, 3, 2, 1):
            padded = f"^{word}$" if k > 1 else word
            known = [model.grams[padded[i : i + k]] for i in range(len(padded) - k + 1) if padded[i : i + k] in model.grams]
            if known:
                total, rest = total + n * model.gram_logs[known].mean(axis=0), rest + n
                break
    fit = float(fit.max()) / len(words)
    if not rest:
        return model.langs[0], 1 / len(model.langs), fit
    odds = np.exp(total * min(1, evidence / rest) - (total * min(1, evidence / rest)).max())
    return model.langs[int(odds.argmax())], float(odds.max() / odds.sum()), fit


@pytest.mark.parametrize("together", [7, 100_000])
def test_reader_follows_the_rule(spark, together, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    model = language_id.fit(df.filter("length(text) % 3 > 0"), words=800, grams=1500)
    rng = random.Random(1)
    texts = [r["text"] for r in df.collect()] + [None, "", "12", "a", "ab", "q xz", "漢字 仮名", "² ½ Ⅷ", "हिन्दी में लिखा", "naïve İst", "́"]
    texts += ["".join(rng.choices("abcxyzäé 1", k=rng.randint(0, 40))) for _ in range(300)]
    monkeypatch.setattr(language_id, "WORDS_TOGETHER", together)
    monkeypatch.setattr(language_id, "MEMO_BYTES", 20_000)
    found = list(language_id.Reader(model).judge(texts))
    for text, (lang, score, fit) in zip(texts, found, strict=True):
        want = plain(model, text)
        assert (score, fit) == pytest.approx(want[1:], abs=1e-9)
        assert lang == want[0] or score == pytest.approx(1 / len(model.langs), abs=0.3)


def test_words_are_letters_with_their_marks():
    assert language_id.LETTERS.findall("² ½ Ⅷ 12_3") == []
    assert language_id.LETTERS.findall("हिन्दी में a1b é é") == ["हिन्दी", "में", "a", "b", "é", "é"]
    for c in range(0, 0x30000, 7):
        if not 0xD800 <= c < 0xE000:
            assert bool(language_id.LETTERS.fullmatch(chr(c))) == (unicodedata.category(chr(c))[0] == "L")
            text = f"a{chr(c)}b {chr(c)}"
            assert language_id.words_of(text) == language_id.LETTERS.findall(text.lower())


def test_no_letter_is_undetermined(spark):
    df = spark.createDataFrame([(1, "the cat", "en"), (2, "die katze", "de"), (4, "² ½", "en"), (3, "Ⅷ", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()}
    assert found[4] == found[3] == ("und", 0.0)


def test_stage_with_clashing_names_nulls_and_nothing(spark):
    kind = "doc_id long, text string, lang string, _language string, p int, _l int"
    a, b = [i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(a, "the cat and the dog", "en", "mine", 1, 2), (b, "der hund und die katze", "de", None, 3, 4), (None, "the dog", None, "x", 5, 6), (99, None, "en", "", 7, 8)]
    df = spark.createDataFrame(rows, kind)
    kept = {tuple(r) for r in stages.keep_known_languages(df).collect()}
    assert kept == {rows[0], rows[1], (None, "the dog", "en", "x", 5, 6)}
    assert stages.keep_known_languages(spark.createDataFrame([], kind)).collect() == []
