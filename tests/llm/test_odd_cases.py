"""Every operator on odd tables: very long texts, repeated and missing ids, clashing names, no rows; and brute force for
the models and for what SQL can't express."""

import hashlib
import math
import random
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from skein.llm import ann, common, langid, licenses, lines, media, mixing, packing, quality, simhash, suffix
from skein.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, units string, rank int, v string, key string, label string"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); columns whose names the operators use too are added."""
    return spark.createDataFrame([(*r, 7, "x", "y", 3, "v", "k", "l") for r in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """A text of over 1 MB, repeated rows and ids, rows without ids, nulls, empty texts, ties."""
    rng = random.Random(11)
    shared, long = words(rng, 60), words(rng, 200_000)
    rows = [(1, long, "en", "src0"), (2, f"{words(rng, 30)} {shared} {words(rng, 20)}", "en", "src1"), (3, f"{words(rng, 5)}\n{shared}", "de", "src0"), (3, f"{words(rng, 5)}\n{shared}", "de", "src0")]
    rows += [(4, words(rng, 90), "de", None), (4, words(rng, 90), None, "src2"), (4, f"{words(rng, 3)}\n{shared}", "fr", "src2"), (5, None, "en", "src1"), (6, "", None, None), (None, shared, "en", "src0"), (None, None, None, None), (7, "   \n\t ", "en", "src0"), (8, long[:600_000], "en", "src3")]
    assert len(long) > common.SLICE_BYTES
    return rows


QUERIES = {
    "op1": lambda df: licenses.op1(df),
    "op2": lambda df: media.op2(df),
    "op3": lambda df: langid.op3(df),
    "op4": lambda df: simhash.op4(df),
    "op6": lambda df: suffix.op6(df),
    "op9": lambda df: lines.op9(df),
}


@pytest.mark.parametrize("name", QUERIES)
def test_one_row_for_each_row(spark, odd, name):
    df = frame(spark, odd)
    rows = QUERIES[name](df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in odd)
    empty = QUERIES[name](df.limit(0))
    assert empty.count() == 0 and [f.name for f in empty.schema] == [f.name for f in QUERIES[name](df).schema]


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i % 9, i % 2) for i in range(40)] + [(None, 1), (2, None)], "doc_id long, quality int")
    rows = quality.op5(frame(spark, odd), labels).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all((r["held_out"] is None) == (r["doc_id"] is None) for r in rows)


def test_very_long_texts_by_brute_force(spark, odd):
    """What op1, op2, op4, op6 and op9 say of the text of over 1 MB and of the one that is its beginning."""
    long, part = odd[0][1], odd[-1][1]
    df = frame(spark, [odd[0], odd[-1]])
    raw, cut = long.encode(), part.encode()
    assert {r["doc_id"]: r["n_words"] for r in licenses.op1(df).collect()} == {1: len(long.split()), 8: len(part.split())}
    assert {r["doc_id"]: (r["n_bytes"], r["payload_sha256"]) for r in media.op2(df).collect()} == {i: (len(x), hashlib.sha256(x + bytes(-len(x) % 64)).hexdigest()) for i, x in ((1, raw), (8, cut))}
    # the whole beginning stands earlier, in document 1
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix.op6(df).collect()} == {1: (0, hashlib.sha256(raw).hexdigest()), 8: (len(cut), hashlib.sha256(b"").hexdigest())}
    by_id = {r["doc_id"]: r for r in lines.op9(df).collect()}
    assert by_id[1]["n_removed"] == 0 and by_id[1]["text"] == long and len(by_id[8]["text"]) < 100
    assert {r["component_id"] for r in simhash.op4(df).collect()} <= {1, 8}
    ids = np.frombuffer(packing.byte_bpe_50k().encode(long), "<u4")
    pieces = sorted((r for r in packing.op8(df).collect() if r["doc_id"] == 1), key=lambda r: r["start"])
    assert sum(r["length"] for r in pieces) == len(ids) + 1 == pieces[0]["doc_tokens"]
    assert pieces[3]["ids_crc32"] == zlib.crc32(ids[pieces[3]["start"] : pieces[3]["start"] + pieces[3]["length"]].tobytes())


def test_packing_of_odd_rows(spark, odd):
    rows = packing.op8(frame(spark, odd)).collect()
    tokens = Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    bpe, want = packing.byte_bpe_50k(), Counter()
    for doc_id, text, *_ in odd:
        want[doc_id] += len(bpe.encode(text or "")) // 4 + 1
    assert tokens == want
    assert packing.op8(frame(spark, odd).limit(0)).count() == 0


def duck(odd, sql):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r for r in odd], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}).convert_dtypes())
    found = con.sql(sql)
    return found.columns, found.fetchall()


@pytest.mark.parametrize("name", ["op1_license_scan", "op6_suffix_dedup", "op9_line_dedup", "op10_mixing"])
def test_against_sql(spark, odd, name):
    """With one row for each doc_id, as the SQL wants it."""
    seen, rows = set(), []
    for r in odd:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append((r[0], (r[1] or "")[:40_000] or r[1], *r[2:]))
    df = frame(spark, rows)
    got = {"op1_license_scan": licenses.op1, "op6_suffix_dedup": suffix.op6, "op9_line_dedup": lines.op9, "op10_mixing": mixing.op10}[name](df)
    columns, want = duck(rows, oracle_sql()[name])
    clean = lambda rows: sorted(repr(tuple(None if v is None or v is pd.NA else v for v in r)) for r in rows)
    assert clean(got.select(*columns).collect()) == clean(want)


# -- line dedup


def brute_lines(docs, least):
    """Units, repeats and what is left, from the definition: words, pieces, paragraphs of at least so many words."""
    space, seen, order, out = " \t\n\r\f\v", {}, [], {}
    for doc_id, text in sorted(docs):
        tokens, at = [], 0
        while at < len(text):
            if text[at] in space:
                at += 1
                continue
            to = at
            while to < len(text) and text[to] not in space:
                to += 1
            end = to
            while end < len(text) and text[end] in space:
                end += 1
            tokens.append((at, end, text[at:to].translate({c: c + 32 for c in range(65, 91)}), "\n" in text[to:end] or end == len(text)))
            at = end
        pieces = [[]]
        for t in tokens:
            pieces[-1].append(t)
            raw = t[2].encode()
            if t[3] or raw[-1:] in b".!?" or (len(raw) + (raw[-1] & 63)) % 4 == 0:
                pieces.append([])
        pieces = [p for p in pieces if p]
        order.append((doc_id, text, pieces))
    first = {}
    for doc_id, _, pieces in order:
        for k in range(len(pieces)):
            n, form = 0, []
            for j in range(k, len(pieces)):
                form += [w[2] for w in pieces[j]]
                if len(form) >= least:
                    key = " ".join(form)
                    first.setdefault(key, (doc_id, k))
                    seen[doc_id, k] = (key, j)
                    break
    for doc_id, text, pieces in order:
        gone = set()
        for k in range(len(pieces)):
            if (doc_id, k) in seen and first[seen[doc_id, k][0]] != (doc_id, k):
                gone |= set(range(k, seen[doc_id, k][1] + 1))
        ranges = [(pieces[k][0][0], pieces[k][-1][1]) for k in sorted(gone)]
        kept = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in ranges))
        out[doc_id] = (len(pieces), len(gone), sum(b - a for a, b in ranges), kept)
    return out


@pytest.mark.parametrize("least", [0, 7, lines.LEAST])
def test_lines_by_brute_force(spark, least):
    rng = random.Random(3)
    vocabulary = [w + e for w in ("Über", "und", "the", "Thing", "é", "abcd", "xyz", "q") for e in ("", "", "", ".", ",")]
    say = lambda n: rng.choice(["", " ", "\n"]).join([""] * 1) + "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))
    shared = [say(70) for _ in range(3)]
    docs = [(i, "  " + say(rng.randint(0, 40)) + (rng.choice(shared) if i % 2 else "") + say(rng.randint(0, 40))) for i in range(30)] + [(50, ""), (51, shared[0]), (52, shared[0].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["removed_chars"], r["text"]) for r in lines.dedup(df, least).collect()}
    assert got == brute_lines(docs, least)


def test_collapsing_in_a_task_changes_nothing(spark, monkeypatch):
    rng = random.Random(9)
    shared = words(rng, 80)
    docs = [(i, f"{words(rng, 9)} {shared} {words(rng, 9)}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(lines, "COLLAPSE", 50)
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()} == {i: x[3] for i, x in brute_lines(docs, lines.LEAST).items()}


def test_texts_of_one_doc_id_keep_their_own_lines(spark):
    rng = random.Random(2)
    shared, other = words(rng, 50), words(rng, 50)
    df = spark.createDataFrame([(1, shared), (2, shared), (2, other)], "doc_id long, text string")
    assert sorted(r["text"] for r in lines.dedup(df).collect()) == sorted([shared, brute_lines([(1, shared), (2, shared)], lines.LEAST)[2][3], other])


# -- media


def test_media_by_another_decoder(spark, odd):
    """All of op2's columns, from the stored bytes, by a reader of PNG of its own."""
    docs = [(i, t) for i, (_, t, *_) in enumerate(odd)] + [(90, "é\0"), (91, "é")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    manifest = {r["doc_id"]: r for r in media.store(df).collect()}
    for row in media.op2(df).collect():
        raw = dict(docs)[row["doc_id"]]
        raw = (raw or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        place = manifest[row["doc_id"]]
        with open(place["shard"].removeprefix("file://"), "rb") as f:
            f.seek(place["offset"])
            stored = f.read(place["length"])
        at, chunks = 8, defaultdict(bytes)
        while at < len(stored):
            n, kind = struct.unpack(">I4s", stored[at : at + 8])
            assert zlib.crc32(stored[at + 4 : at + 8 + n]) == struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]
            chunks[kind] += stored[at + 8 : at + 8 + n]
            at += 12 + n
        width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        scan = zlib.decompress(chunks[b"IDAT"])
        samples = b"".join(scan[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))
        assert samples == payload and (depth, colour) == (8, 0) and set(scan[:: width + 1]) == {0}
        assert row["payload_bytes"] == len(payload) and row["n_bytes"] == len(raw) and row["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (row["media_bytes"], row["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert row["feature"] == f"png {width}x{height} gray8 sum={sum(payload)} distinct={len(set(payload))}"


@pytest.mark.parametrize("folder", ["/tmp/x", "file:/tmp/x", "file:///tmp/x"])
def test_folders_that_spark_names(folder):
    assert common.filesystem(folder)[1] == "/tmp/x"


# -- models


def test_language_by_brute_force(spark):
    """Naive Bayes from its definition, gram by gram in Python."""
    rng = random.Random(5)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(rng.randint(1, 25)))
    docs = [(i, say({"en": "etaoinsh", "de": "enisrüöß", "fr": "esaitéçn"}[lang]), lang, None) for i in range(120) for lang in [rng.choice(["en", "de", "fr"])]] + [(200, "Été", "fr", None), (201, "12", "en", None)]

    def grams(text):
        text, out = text.lower(), []
        for n in langid.ORDERS:
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                out.append((h >> 48) % langid.BUCKETS)
        return out

    counts, priors = defaultdict(Counter), Counter()
    for doc_id, text, lang, _ in docs:
        if zlib.crc32(str(doc_id).encode()) % 4 != 2:
            counts[lang].update(grams(text))
            priors[lang] += 1
    langs = sorted(priors)
    total = {x: sum(counts[x].values()) + 0.1 * langid.BUCKETS for x in langs}
    rows = {r["doc_id"]: r for r in langid.op3(frame(spark, docs)).collect()}
    for doc_id, text, *_ in docs:
        logs = [math.log(priors[x] / sum(priors.values())) + sum(math.log((counts[x][g] + 0.1) / total[x]) for g in grams(text)) for x in langs]
        best = max(logs)
        if any(c.isalpha() for c in text):
            assert rows[doc_id]["lang_pred"] == langs[logs.index(best)]
            assert rows[doc_id]["score"] == pytest.approx(1 / sum(math.exp(x - best) for x in logs), abs=1e-3)
        else:
            assert (rows[doc_id]["lang_pred"], rows[doc_id]["score"]) == ("und", 0)


def test_quality_by_brute_force(spark):
    """The vote of the nearest neighbours, one document at a time, over the fitted vectors."""
    rng = random.Random(7)
    docs = [(i, words(rng, rng.randint(1, 40)) + "!" * (i % 3), None, None) for i in range(150)]
    docs[40:44] = [(i, docs[10][1], None, None) for i in range(40, 44)]  # ties
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int")
    df = frame(spark, docs)
    model = quality.fit(df, labels.where(~quality.held_out()))
    rows = {r["doc_id"]: r["score"] for r in quality.op5(df, labels).collect()}
    for doc_id, text, *_ in docs:
        raw = np.frombuffer(text.encode(), np.uint8)
        x = (quality.counts(raw, np.array([0, len(raw)])) * model.idf) @ model.axes
        x = x[0] / max(np.linalg.norm(x[0]), 1e-12)
        cosines = [(float(np.dot(x, v)), i) for i, v in enumerate(model.vectors)]
        near = sorted(cosines, key=lambda c: (-c[0], c[1]))[: quality.NEIGHBOURS]
        weights = [(max(c, 0) ** quality.POWER, float(model.votes[i])) for c, i in near]
        assert rows[doc_id] == pytest.approx(sum(w * v for w, v in weights) / sum(w for w, _ in weights), abs=2e-3)


def test_ties_of_neighbours_go_to_the_first():
    cosines = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]])
    assert quality.nearest(cosines, 3).tolist() == [[0, 1, 2], [0, 1, 2]]
    assert quality.nearest(cosines, 5).tolist() == [[0, 1, 2, 3, 4]] * 2


# -- nearest neighbours


def test_nearest_with_clashing_names_and_wide_ranges(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 5))
    v[200:230] *= 1e160
    v[230:260] *= 1e-170
    rows = [(i, [float(x) for x in r], "v", 1, 2.0) for i, r in enumerate(v)] + [(None, [1.0] * 5, "v", 1, 2.0), (100, [0.0] * 5, "v", 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, rank int, score double").repartition(4)
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, df.where("vec_id % 50 = 0"), k=12, tile=16, per_cell=2).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 300, 50):
        want = sorted((math.hypot(*(v[i] - v[q])), i) for i in range(300) if i != q)[:12]
        assert np.allclose([s for _, s in got[q]], [d for d, _ in want], rtol=1e-12, atol=0)
        assert [i for i, _ in got[q]] == [i for _, i in want]


def test_few_finite_candidates_are_all_found(spark):
    df = spark.createDataFrame([(100, [1e200, 0.0]), (1, [-1e200, 0.0]), (2, [1e200, 1.0]), (3, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in sorted(ann.op7(df).collect(), key=lambda r: r["rank"])] == [(2, 1.0), (3, 1e200), (1, 2e200)]


# -- licences, mixing, packing


def test_licences_of_a_table(spark):
    rng = random.Random(8)
    texts = {"odd-1": words(rng, 120), "it's": "Permission to use this \"thing\" for any purpose, with fee, is granted: " + words(rng, 30)}
    table = spark.createDataFrame([(k, t, [" ".join(t.split()[2:5])], 0.9) for k, t in texts.items()], "label string, text string, keys array<string>, agree double")
    near = texts["odd-1"].split()
    far = list(near)
    near[50] = near[90] = "changed"
    for i in range(10, 30):
        far[i] = "changed"
    no_key = list(texts["odd-1"].split())
    no_key[3] = "changed"
    docs = [(1, words(rng, 50) + " " + texts["odd-1"]), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(no_key)), (5, texts["it's"].upper() + " all rights reserved"), (6, None)]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    assert {i: r["labels"] for i, r in rows.items()} == {1: "odd-1", 2: "odd-1", 3: "", 4: "", 5: "it's,reserved", 6: ""}
    assert [(p["label"], p["start"]) for p in rows[1]["places"]] == [("odd-1", 50)] and rows[2]["score"] == pytest.approx(118 / 120)
    big = table.withColumn("text", table["text"])
    with pytest.raises(ValueError):
        licenses.templates_of(spark.createDataFrame([("x", "a " * licenses.INDEX_BYTES, ["a"], 1.0)], big.schema))


def test_domains_are_a_parameter(spark):
    docs = [(i, "a b c d", "en", f"src{i % 4}") for i in range(40)]
    plan = mixing.Plan({"left": 3.0, "rest": 1.0}, {}, {}, 0.4, 1, 1, {"src1": "left", "src2": "left"})
    keyed = common.materialise(mixing.leaves(frame(spark, docs), plan.domain_of), "t")
    taken = Counter()
    for r in mixing.choose(keyed, plan).collect():
        taken[r["domain"]] += r["take_tokens"]
    assert taken == {"left": 48, "rest": 16}


def test_conversations_within_three_limits(spark):
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), words(rng, rng.randint(0, 120))) for c in range(150) for t in range(rng.randint(1, 9))] + [(900, 0, "assistant", words(rng, 3000)), (901, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3)
    bpe, size = packing.byte_bpe_50k(), defaultdict(lambda: np.zeros(3, int))
    for c, _, role, text in turns:
        n = len(bpe.encode(text or "")) // 4 + 1
        size[c] += (n, 1, n if role == "assistant" else 0)
    by_sequence = defaultdict(list)
    for r in packing.pack_conversations(df).collect():
        by_sequence[r["sequence_id"]].append((r["offset"], r["conv_id"]))
    assert sorted((c is None, c or 0) for x in by_sequence.values() for _, c in x) == sorted((c is None, c or 0) for c in size)
    for held in by_sequence.values():
        total = sum(size[c] for _, c in held)
        assert (total <= packing.CONVERSATION_LIMITS).all() or len(held) == 1
        at = 0
        for offset, c in sorted(held, key=lambda x: x[0]):
            assert offset == at
            at += size[c][0]
    assert packing.pack_conversations(df.limit(0)).count() == 0


# -- pipeline


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([(r[0], (r[1] or "")[:30_000] if r[1] is not None else None, r[2], r[3], 1) for r in odd], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = corpus_pipeline.materialise(left, "odd")
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_queries_with_sql():
    assert set(oracle_sql()) <= set(queries()) and {"op1_license_scan", "op6_suffix_dedup", "op7_nearest", "op9_line_dedup", "op10_mixing"} == set(oracle_sql())


def test_queries_are_listed_without_a_session():
    root = Path(__file__).parents[2]
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=root, capture_output=True, text=True, timeout=120)
    assert "pipeline" in said.stdout.split(), said.stderr
