"""Suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from skein.llm import suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, th string"


def brute(docs, length):
    seen, out = {}, {}
    for doc_id, text in sorted((d, t or "") for d, t in docs):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = True
            else:
                seen[raw[s : s + length]] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[doc_id] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(2, 9))) for _ in range(4000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(30) for _ in range(6)]
    texts = [say(rng.randint(1, 80)) for _ in range(40)]
    texts += [say(5) + s + say(rng.randint(0, 20)) for s in shared for _ in range(5)]
    texts += [texts[0], texts[0], texts[1][:150] + "x" + texts[1][150:], "", None, "ab" * 400, "ab" * 300, "z" * 99, "z" * 100, "z" * 101, say(3000), shared[0] * 3]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_repeated_strings_of_a_text():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    text[[100, 300, 599]] = suffix.END
    for length in (5, 8, 11, 16):
        interval, at = suffix.repeated(text, length)
        found = {}
        for i, p in zip(interval, at, strict=True):
            found.setdefault(int(i), set()).add(int(p))
        raw, want = text.tobytes(), {}
        for p in range(len(raw) - length + 1):
            if b"\xff" not in raw[p : p + length]:
                want.setdefault(raw[p : p + length], set()).add(p)
        assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


@pytest.mark.parametrize(("group", "size"), [(8192, 1 << 22), (3, 1 << 22), (8192, 600), (1, 1)])
def test_against_brute_force(spark, monkeypatch, group, size):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "GROUP_BYTES", size)
    docs = corpus()
    df = spark.createDataFrame([(d, t, None, None, 0, "clash", "clash") for d, t in docs], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op6(df).collect()}
    assert got == brute(docs, suffix.MIN_LENGTH)


def test_a_long_text_is_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_POSITION_BITS", 10)
    docs = [(d, t) for d, t in corpus() if t and len(t) > 900]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op6(df).collect()}
    assert got == brute(docs, suffix.MIN_LENGTH)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.op6(empty).count() == 0
    df = spark.createDataFrame([(None, "q" * 300), (1, "q" * 300), (1, "q" * 300), (1, "q" * 120)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix.op6(df).collect())
    assert rows[0] == (0, 300, 0)
    assert rows[-1] == (1, 300, 299)


def test_cut_texts_stay_utf8(spark):
    docs = [(d, t, "en") for d, t in corpus()]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = suffix.dedup(df, "lang").collect()
    assert len(rows) == len(docs)
    assert all(r["lang"] == "en" and r["text"] is not None for r in rows)


@pytest.mark.parametrize("docs", [[(1, "z" * 101)], [(1, "".join(chr(97 + i % 25) + "é" * (i % 25 == 3) for i in range(52)) * 3)], [(1, "-" * 120)], [(1, "intro " + "=-" * 70), (2, "intro " + "=-" * 70)], [(1, bytes(range(33, 101)).decode() * 3)], [(1, "z" * 101), (2, "z" * 101)]])
def test_repeats_within_one_short_run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op6(df).collect()}
    assert got == brute(docs, suffix.MIN_LENGTH) and got[1][1] > 0


def test_refined_groups_keep_equal_windows_together():
    rng = random.Random(4)
    core = "".join(rng.choices("abc", k=90))
    texts = ["".join(rng.choices("ab", k=60)) + core + "".join(rng.choices("ab", k=60)) for _ in range(60)] + ["z" * 300, "xy" * 130]
    raw = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    data, powers = np.frombuffer(raw, np.uint8), suffix._powers(len(raw))
    for depth in range(suffix.depths(100) + 1):
        groups, cells = {}, {}
        for key, row, a, n in zip(*(x.tolist() for x in suffix.refine(data, offsets, 100, depth, powers)), strict=True):
            for s in range(a, a + n):
                window = raw[offsets[row] + s : offsets[row] + s + 100]
                assert (row, s) not in cells and groups.setdefault(window, key) == key
                cells[row, s] = key
        assert set(cells) == {(r, s) for r, x in enumerate(texts) for s in range(len(x) - 99)}
    assert len(set(groups.values())) == len(groups)  # in the end a group's windows are equal


def test_runs_left_out_hold_no_repeat():
    rng = random.Random(8)
    for _ in range(300):
        period = rng.randint(1, 75)
        unit = "".join(rng.choices("ab" if rng.random() < 0.3 else "abcdefgh", k=period))
        raw = ("".join(rng.choices("xyz", k=rng.randint(0, 40))) + unit * (1 + rng.randint(100, 260) // period)).encode()
        _, _, start, n, several = suffix.runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 100, suffix._powers(1 << 10))
        for s, k, own in zip(start.tolist(), n.tolist(), several.tolist(), strict=True):
            run = raw[s : s + k + 99]
            if len({run[i : i + 100] for i in range(k)}) < k:
                assert own and suffix.may_repeat(run, 100)
