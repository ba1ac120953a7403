"""Exact dedup, importance resampling and spelling variants: odd tables, and brute force on small ones."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from canopy.llm.exact_dedup import drop_copies, frequent, mark_copies
from canopy.llm.importance_resampling import draw, ngrams, resample
from canopy.llm import spelling
from canopy.llm.spelling import near_pairs, one_edit, spelling_forms
from canopy.llm.spelling_query import counted_words

DOCS = "doc_id bigint, text string, lang string, kept string, rank string, row string, digest string, word string, __row string, id string"
LONG = "wörd Word " * 30_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, " "), (5, "a\x00b  c"), (5, "a\x00b c"), (5, "a\x00b  c"), (None, "a\x00b\tc"), (None, "x"), (None, "x"),
       (6, LONG), (7, LONG.replace(" ", "\n")), (8, "y" * 100_000), (9, "Y" * 100_000), (-1, "a\x00b c ")]
OTHER = ("xx", "k", "r", "w", "d", "o", "q", "i")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *OTHER) for i, t in ODD], DOCS)


def test_frequent_keys_are_all_found(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks without rows stay
    rng = random.Random(1)
    keys = [k for k in range(20) for _ in range(400)] + [rng.getrandbits(60) for _ in range(12_000)]
    rng.shuffle(keys)
    found = {r["k"] for r in frequent(spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(7), "k", 50).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(range(20)) <= found and len(found) <= 100


@pytest.mark.parametrize("shares", [1, 3, 4, 1024])
def test_exact_dedup_odd(odd, shares):
    found = mark_copies(odd, shares=shares).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(i)
    want = Counter((i, min((x for x in ids if x is not None), default=None), len(ids), d) for d, ids in groups.items() for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    stay = Counter((r["text_sha256"], r["doc_id"]) for r in found if r["kept"])
    assert stay == Counter({(d, min((x for x in ids if x is not None), default=None)): 1 for d, ids in groups.items()})
    assert found[0].asDict().keys() == {*odd.columns, "keep_id", "group_size", "text_sha256"}


def test_dropped_copies_leave_rows_as_they_were(odd):
    rows = drop_copies(odd, shares=3).collect()
    assert rows[0].asDict().keys() == set(odd.columns) and len(rows) == 8
    assert {r["doc_id"]: r["text"] for r in rows}[1] is None and all(tuple(r)[2:] == OTHER for r in rows)
    assert drop_copies(odd.limit(0)).count() == 0 and mark_copies(odd.limit(0), ["doc_id"]).count() == 0


def test_a_group_with_a_third_of_all_rows_is_settled_before_the_shuffle(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) AS text")
    found = mark_copies(docs, ["doc_id"])
    assert found.where("group_size = 1000 AND keep_id = 0 AND kept = (doc_id = 0)").count() == 1000 and found.where("kept").count() == 2001
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan and "Python" not in plan


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("portion", [1, 9, 60, 1 << 21])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_of_a_batch_are_those_of_its_texts(portion, n):
    rng = random.Random(portion)
    texts = ["".join(rng.choice("aB9 é.,漢\x00Z") for _ in range(rng.choice((0, 1, 5, 30, 300)))) for _ in range(30)]
    texts += ["x" * 200 + " " + "y" * 70 + " é" * 50, "", "?", "z" * 5_000]
    found = defaultdict(list)
    for _, docs, crc in ngrams([t.encode() for t in texts], n, portion):
        for d, c in zip(docs.tolist(), crc.tolist()):
            found[d].append(c)
    assert all(sorted(found[d]) == sorted(features(t, n)) for d, t in enumerate(texts))


def brute_resample(docs, target, percent, min_words, n, buckets, seed):
    s = Counter(f % buckets for _, t in docs for f in features(t, n))
    t = Counter(f % buckets for x in target for f in features(x, n))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (s_all + buckets)) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        f = features(x, n)
        weight = sum(gain[c % buckets] for c in f) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    entered = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(entered[:percent * len(entered) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def test_resample_is_brute_force(spark, odd):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(("alpha", "Beta", "gämma", "δ", "x1")) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    target = ["alpha beta alpha gämma", None, "", "x1 x1"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    for n, buckets, percent in ((2, 10_000, 25), (3, 50, 60)):
        found = resample(df, tf, columns=["doc_id"], max_n=n, buckets=buckets, percent=percent).collect()
        assert sorted(map(tuple, found)) == sorted(brute_resample(docs, target, percent, 20, n, buckets, 7))
        drawn = draw(df, tf, max_n=n, buckets=buckets, percent=percent).collect()
        assert {(r["doc_id"], r["text"]) for r in drawn} == {(i, t) for i, t in docs if i in {r["doc_id"] for r in found if r["rank"]}}


def test_resample_odd(spark, odd):
    target = spark.createDataFrame([("wörd",)], "text string")
    found = resample(odd, target, percent=100, min_words=1)
    want = brute_resample(ODD, ["wörd"], 100, 1, 2, 10_000, 7)
    rows = found.collect()
    none_last = lambda x: tuple((v is None, v or 0) for v in x)
    no_rank = lambda r: none_last((r[0], r[1], r[2], r[3]))  # noqa: E731  equal rows may share their ranks out either way
    assert sorted(map(no_rank, want)) == sorted(no_rank((r["doc_id"], r["n_features"], r["weight"], r["score"])) for r in rows)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 12)) and all(r["__row"] == "q" and r["row"] == "w" for r in rows)
    assert rows[0].asDict().keys() == {*odd.columns, "n_features", "weight", "score"}
    assert resample(odd.limit(0), target).count() == 0 and resample(odd, target.limit(0), percent=100).where("rank > 0").count() == 2
    assert draw(odd, target, percent=100, min_words=1).columns == odd.columns


def near_by_force(words):
    out = set()
    for a in words:
        for b in words:
            if len(a) == len(b):
                near = sum(x != y for x, y in zip(a, b)) == 1
            else:
                s, t = sorted((a, b), key=len)
                near = len(t) - len(s) == 1 and any(t[:i] + t[i + 1:] == s for i in range(len(t)))
            if near:
                out.add((a, b))
    return out


def some_words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ漢") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    for w in list(base):
        i, c = rng.randrange(len(w)), rng.choice("abcé")
        base += [w[:i] + c + w[i + 1:], w[:i] + c + w[i:], "".join(rng.sample(w, len(w)))]
    return sorted(set(base)) + ["z" * 3000, "z" * 2999 + "y", "z" * 3001, "z" * 300, "z" * 256, "z" * 255, "z" * 254 + "a"]


@pytest.mark.parametrize("leaf, sample", [(1 << 14, 1 << 17), (40, 1 << 17), (4, 200), (3, 1)])
def test_near_pairs_are_brute_force(spark, monkeypatch, leaf, sample):
    """Whole trees, many leaves, leaves far larger than planned (blocks), and no tree at all."""
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    monkeypatch.setattr(spelling, "LEAST", 2)
    monkeypatch.setattr(spelling, "SMALL", 3)
    words = some_words(leaf, 130)
    count = {w: 2 + i for i, w in enumerate(words)}
    df = spark.createDataFrame(list(count.items()), "word string, n bigint").repartition(3)
    found = [(r["word"], r["near"], r["near_n"]) for r in near_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b, count[b]) for a, b in near_by_force(words)}


def test_one_edit_is_exact():
    def codes(*words):
        return np.array([[ord(c) for c in w] for w in words], np.uint32)
    assert one_edit(codes("abc", "abc", "abc"), codes("abd", "abc", "acb")).tolist() == [True, False, False]
    assert one_edit(codes("aab", "abc", "abc"), codes("aaab", "abdc", "bacd")).tolist() == [True, True, False]


def test_forms_and_roots(spark):
    rows = [("colour", 2), ("color", 20), ("colon", 20), ("colors", 2000), ("colorz", 19), ("abc", 5), (None, 9), ("", 9), ("abc", 5), ("abd", 99), ("color's", 200)]
    df = spark.createDataFrame([(w, n, "x") for w, n in rows], "word string, n bigint, form string")
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_forms(df).collect()}
    assert found == {"colour": ("color", "colors", 2, 1, 20), "color": ("colors", "colors", 20, 4, 2000), "colon": (None, "colon", 20, 1, None),
                     "colors": (None, "colors", 2000, 3, None), "colorz": ("colors", "colors", 19, 2, 2000), "abc": (None, "abc", 10, 1, None),
                     "abd": (None, "abd", 99, 1, None), "color's": ("colors", "colors", 200, 1, 2000)}
    assert spelling_forms(df.limit(0)).count() == 0
    ties = spark.createDataFrame([("word", 1), ("ward", 50), ("ford", 50), ("worde", 50)], "word string, n bigint")
    assert {r["word"]: r["form"] for r in spelling_forms(ties).collect()}["word"] == "ford"
    with pytest.raises(ValueError):
        spelling_forms(ties, ratio=1)


def test_counted_words_are_brute_force(spark, odd):
    docs = [(i, t) for i, t in ODD] + [(i, "Étoile étoiles ABCDEFG abcdefgh-abcdefgh x÷yzzzzz " * 40) for i in range(40)]
    want = Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w
            want[w] += len(w) >= 7
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["word"]: r["n"] for r in counted_words(df).collect()} == {w: n for w, n in want.items() if n >= 2}


def test_decontamination_is_brute_force(spark, monkeypatch):
    """Random texts over few words, items of all lengths, small stretches and portions, two blocks."""
    from canopy.llm import decontaminate as D

    monkeypatch.setattr(D, "STRETCH", 7)
    monkeypatch.setattr(D, "PORTION", 300)
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    rng = random.Random(6)
    word = lambda: rng.choice(("a", "b", "Ab", "é", "c1", "漢", "zz"))
    items = [(f"i\0{k}" if k % 3 else str(k), " ".join(word() for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 9, 14))))) for k in range(40)]
    items += [(None, "b b b"), ("i", None), ("twice", "a b c1"), ("twice", "c1 b a")]
    docs = [(k, rng.choice((" ", ",", "\n")).join(word() for _ in range(rng.choice((0, 1, 3, 8, 30, 90))))) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id bigint, text string, hits string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r for r in D.find_contamination(df, bench, window=4).collect()}
    for i, t in docs:
        w, hit, own = D.words_of((t or "").encode()), set(), set()
        for name, text in items:
            p = D.words_of((text or "").encode())
            for s in range(max(1, len(p) - 3) if p else 0):
                window = p[s:s + 4]
                for at in range(len(w) - len(window) + 1):
                    if w[at:at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        own.add(name or "")
        spans = {x for h in got[i]["hits"] for x in range(h["start"], h["start"] + h["length"])}
        assert (spans, got[i]["items"], got[i]["n_words"]) == (hit, sorted(own), len(w))
    left = D.decontaminate(df, bench, window=4).collect()
    assert {r["doc_id"] for r in left} == {i for i in got if not got[i]["hits"]} and all(tuple(r)[2] == "own" for r in left) and left


def test_a_large_benchmark_needs_little_memory(tmp_path):
    """16 MB of items as files of arrays: packing and searching stay below 500 MB in a worker."""
    import subprocess
    import sys
    code = f"""
import random, resource
import pyarrow as pa
from canopy.llm import decontaminate as D
from canopy.llm.common import write_arrays
rng = random.Random(1)
vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(50_000)]
for block in range(2):
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(21_000)]
    batch = pa.record_batch([pa.array([f"{{block}}-{{i}}" for i in range(len(texts))]), pa.array(texts)], names=["i", "t"])
    write_arrays(f"{tmp_path}/{{block}}.arrow", D._pack([batch], 10))
planted = " ".join(texts[7].split()[20:45])
del texts, batch
words = D.Words([(" ".join(rng.choice(vocabulary) for _ in range(2000)) + " " + (planted if i == 5 else "")).encode() for i in range(200)])
found = [x for b in range(2) for g in D._block(f"{tmp_path}/{{b}}.arrow") for x in g.search(words)]
print(len(found), found[0][1], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert out[:2] == ["16", "1-7"] and int(out[2]) < 500


def test_trie_weights_are_not_clipped(tmp_path):
    """A context seen billions of times: its rare successors and its back-off weight keep their size, and sums stay one."""
    import pyarrow as pa
    from canopy.llm import lm_trie as L
    from canopy.llm.common import read_arrays, write_arrays

    n = np.array([4_000_000_000, 1, 2, 3, 9_000_000_000_000, 1, 5], np.int64)  # contexts: 4, 2 and 1 successors
    pointers = np.array([0, 4, 6, 7])
    write_arrays(f"{tmp_path}/counts-2-000000.arrow", {"n": n})
    write_arrays(f"{tmp_path}/trie-2-000000.arrow", L.ef_write("pointers", pointers, 8))
    rows = pa.record_batch([pa.array([2], pa.int32()), pa.array([0], pa.int32())], names=["level", "shard"])
    list(L._write_weights(str(tmp_path), {2: [0.5, 0.8, 1.1]})([rows]))
    got = read_arrays(f"{tmp_path}/weights-2-000000.arrow")
    taken = np.array([0, 0.5, 0.8, 1.1])[np.minimum(n, 3)]
    total = np.add.reduceat(n, pointers[:-1])
    want_p = (n - taken) / np.repeat(total, np.diff(pointers))
    want_w = np.add.reduceat(taken, pointers[:-1]) / total
    for name, want in (("p", want_p), ("w", want_w)):
        values = got[f"{name}_values"][got[name]]
        step = (np.log10(want).max() - np.log10(want).min()) / L.STEPS
        assert np.abs(np.log10(values) - np.log10(want)).max() <= step / 2 + 1e-9 and values.min() < 1e-11
    sums = np.add.reduceat(got["p_values"][got["p"]], pointers[:-1]) + got["w_values"][got["w"]]
    assert np.abs(sums - 1).max() < 0.08


def test_encoder_caches_are_bounded_by_bytes():
    """Text without repeats: the caches and the known pairs stay within their bounds, and ids are still the library's."""
    import public_tokenizers
    import sentencepiece
    from canopy.llm.sentencepiece_bpe import Encoder

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(4)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), Encoder(path, cached=60_000, known=500)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    for k in range(60):
        text = " ".join("".join(rng.choices(signs, k=rng.choice((3, 20, 200, 3000)))) for _ in range(8)) + "\n" * (k % 3) + "  x"
        assert own.encode(text) == library.encode(text, add_eos=True)
        held = [sum(4 * len(a) + len(b) + 200 for a, b in c.items()) for c in (own.young, own.old, own.inner)]
        assert max(held) <= 20_000 and sum(map(len, own.fits)) <= 500


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    """Nulls, empty and very long texts, repeated rows and ids, further columns: defined results, no crash."""
    import corpus_pipeline as P
    prose = " ".join(f"word{k % 37}" for k in range(80))
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, prose, "en"), (4, prose, "en"), (5, prose + " end", None), (None, "x", "xx"),
            (6, "z" * 100_000, "fr"), (7, "Ünï 漢字 \x00 <s> " * 5000, "de")]
    odd = spark.createDataFrame([(i, t, lang, "s", 1, "mine", "k") for i, t, lang in rows],
                                "doc_id bigint, text string, lang string, source string, n_chars bigint, hits string, kept string")
    sf, out = "/root/testdata/sf0.001", {}
    for name, stage in P.STAGES:
        found = stage(spark, odd, sf)
        out[name] = [r.asDict() for r in found.collect()]
        assert name == P.STAGES[-1][0] or found.columns == P.COLUMNS
        assert stage(spark, odd.limit(0), sf).count() == 0
    ids = {name: sorted((r["doc_id"] for r in got), key=lambda x: (x is None, x or 0)) for name, got in out.items()}
    assert set(ids["quality rules"]) <= {4, 5, 7}
    assert len(ids["line dedup"]) == len(ids["benchmark decontamination"]) == len(ids["sentencepiece encoding"]) == len(rows)
    assert ids["simhash near-dedup"].count(4) == 1 and 2 not in ids["simhash near-dedup"] and ids["simhash near-dedup"][0] == 1
    assert {r["doc_id"]: r["ids"] for r in out["sentencepiece encoding"]}[1] == [2]
