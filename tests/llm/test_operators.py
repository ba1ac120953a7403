"""Every operator on odd tables and against brute force on the smallest driver tables."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from canopy.llm.queries import llm_oracles, llm_queries
from canopy.sources.tables import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, row_id string, score string"
LONG = "A shared line that is long enough to be counted as one, " * 2
ODD = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "word", "en"), (4, "word", "en"), (5, LONG + "\nown 5", "en"), (6, LONG.lower(), "en"),
       (7, " " + LONG + "\t\n\n", "xx"), (8, LONG, "en"), (9, LONG, "en"), (None, LONG, "en"), (10, "Ünï ▁ 漢字 \x00 <s> " * 3000, "de"),
       (11, "a " * 60_000, "fr"), (12, "x" * 100_000, "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", 1, "w", "k", "r", "c") for i, t, lang in ODD], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def rows(spark, name):
    return llm_queries()[name](spark, SF).collect()


def test_queries_are_the_dealt_ones():
    names = sorted(llm_queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and set(llm_oracles()) <= set(names)


def test_line_dedup_odd(odd):
    from canopy.llm.line_dedup import dedup_lines, keep_bitmaps

    found = {}
    for r in dedup_lines(odd).collect():
        found.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    # Documents null, 5, 6, 7, 8 and 9 hold the line; the largest id keeps it.
    assert found[9] == [(LONG, 1, 0)] and found[5] == [("own 5", 2, 1)] and found[6] == [("", 1, 1)] and found[None] == [("", 1, 1)]
    assert found[7] == [("\n", 3, 1)] and found[1] == [(None, 1, 0)] and found[2] == [("", 1, 0)] and len(found[4]) == 2
    assert {r["doc_id"]: [tuple(k) for k in r["kept"]] for r in keep_bitmaps(odd).collect()}[7] == [(1, 2)]
    assert dedup_lines(odd.limit(0)).count() == 0 and dedup_lines(odd).columns[5:] == ["n_words", "kept", "row_id", "score", "n_lines", "n_dropped"]


def _fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_is_brute_force(spark, docs):
    prints = {d: _fingerprint(t) for d, t in docs.items()}
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(prints):
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, "op5_simhash")} == {
        (d, f"{prints[d]:016x}", find(d)) for d in prints}


def test_simhash_links_join_all_that_brute_force_joins(spark):
    from canopy.llm.components import components
    from canopy.llm.simhash import links

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(40)]
    prints = sorted({*base, *near})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {r["node"]: r["root"] for r in components(links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), 4, leaf=32)).collect()}
    group = {p: p for p in signed}
    values = np.array(prints, np.uint64)
    todo = set(range(len(prints)))
    while todo:
        wave, seen = [min(todo, key=lambda i: signed[i])], set()
        while wave:
            i = wave.pop()
            seen.add(i)
            wave += [j for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4).tolist() if j not in seen and j not in wave]
        for i in seen:
            group[signed[i]] = min(signed[j] for j in seen)
        todo -= seen
    assert {p: found.get(p, p) for p in signed} == group


def test_simhash_odd(odd):
    from canopy.llm.simhash import keep_one, near_duplicates

    ids = {}
    for r in near_duplicates(odd).collect():
        ids.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert ids[1] == ids[2] == ids[3] == {(0, 1)} and {c for _, c in ids[None]} == {6}
    assert sorted(r["doc_id"] for r in keep_one(odd).collect()) == [1, 4, 5, 6, 10, 11, 12]
    assert near_duplicates(odd.limit(0)).count() == 0 and keep_one(odd).columns == odd.columns


def test_keep_one_by_component_not_by_id(spark):
    from canopy.llm.simhash import keep_one

    texts = [" ".join(random.Random(k).choices("one two three four five six seven eight nine ten".split(), k=80)) for k in range(6)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (8, texts[4]), (9, texts[5]), (9, texts[5])]
    found = keep_one(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, texts.index(r["text"])) for r in found) == [(0, 0), (0, 1), (7, 2), (7, 3), (8, 4), (9, 5)]


def test_quality_counts_are_brute_force(spark, docs):
    for r in rows(spark, "op4_quality_rules"):
        text = docs[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines, seen = 0, set()
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                lines += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), failed)
        assert not (failed and r["kept"])


def test_kneser_ney_sums_to_one_and_odd_tables(spark, odd):
    from canopy.llm.char_kn import train
    from canopy.llm.quality_rules import keep_good, quality

    model = train(spark.createDataFrame([("en", "ab abc b cab"), ("en", "ab ca"), (None, "z")], "lang string, text string"), order=3)
    from canopy.llm.char_kn import END, START, hashes, language_seed

    symbols = "abc" + END
    for context in (START * 2, START + "a", "ab", "zz"):
        total = 0.0
        for s in symbols + "?":
            gram, logp = context + s, 0.0
            for size in range(3, -1, -1):
                codes = np.array([[ord(c) for c in gram[3 - size:]]], np.uint32).reshape(1, size)
                v = model.grams.find(hashes(np.array([language_seed("en")]), codes))[0]
                if not np.isnan(v):
                    logp += v
                    break
                w = model.contexts.find(hashes(np.array([language_seed("en")]), codes[:, :-1]))[0]
                logp += 0 if np.isnan(w) else w
            total += 10 ** logp
        assert total == pytest.approx(1, abs=1e-5)
    found = {r["doc_id"]: r for r in quality(odd).collect()}
    assert found[1]["n_words"] == 0 and found[1]["perplexity"] is None and not found[1]["kept"] and found[11]["base_failed"]
    assert keep_good(odd).columns == odd.columns and quality(odd.limit(0)).count() == 0


def test_quality_band_is_not_that_of_a_copied_text(spark):
    from canopy.llm.quality_rules import keep_good, quality

    docs = table(spark, SF, "documents").where("lang = 'en'").select("doc_id", "text", "lang")
    good = quality(docs).where("kept").select("doc_id").join(docs, "doc_id").dropDuplicates(["text"]).orderBy("doc_id").collect()
    copies = [(10_000 + i, good[0]["text"], "en") for i in range(4 * len(good))]
    table_ = spark.createDataFrame([tuple(r) for r in good] + copies, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in keep_good(table_).collect()}
    assert len(good) > 20 and {r["doc_id"] for r in good} <= kept and len(kept) == 5 * len(good)


def test_classifier_held_out_accuracy_and_odd(spark, odd):
    from canopy.llm.compress_classifier import Classifier, classify, fit

    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    found = rows(spark, "op6_compression_classifier")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == q for p, q in held) / len(held) >= 0.85
    none = spark.createDataFrame([(1, 1), (99, 0), (None, 0), (2, 7), (3, None)], "doc_id bigint, label int")
    model = fit(odd.select("doc_id", "text"), none)
    assert all(0 <= r["score"] <= 1 for r in classify(odd, model).collect()) and classify(odd, model).columns.count("score") == 1
    assert fit(odd.select("doc_id", "text"), none.limit(0)) == Classifier() and classify(odd.limit(0), model).count() == 0


def test_decontamination_odd(spark, odd):
    from canopy.llm.decontaminate import find_contamination

    bench = spark.createDataFrame([(1, "WORD"), (1, None), (None, ""), (2, "a a a a a a a a a a a a"), (3, "a a"), (4, "漢字")], "item_id bigint, text string")
    found = {r["doc_id"]: r for r in find_contamination(odd, bench).collect()}
    assert found[4]["items"] == ["1"] and [tuple(h) for h in found[11]["hits"]] == [(0, 60_000)] and found[11]["items"] == ["2", "3"]
    assert found[10]["items"] == ["4"] and found[1]["n_words"] == 0 and found[8]["items"] == []
    assert all(not r["hits"] for r in find_contamination(odd, bench.limit(0)).collect())


def test_sentencepiece_is_the_library(spark, docs, odd):
    from canopy.llm.sentencepiece_bpe import decode, encode, encoder

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    signs = [*"aab eeth \n\t  ▁▁ñé漢字한😀\x00\x01'\"<>s/&#%$.,:;12309ABTHE", " the", "    ", "ing", "\n\n", "<s>", "</s>", "<0x0A>"]
    texts = ["", " ", "   a", "a ", "▁", *docs.values(), *("".join(rng.choices(signs, k=rng.randint(1, 50))) for _ in range(3000))]
    own = encoder(path)
    for text, ids in zip(texts, library.encode(texts, add_eos=True), strict=True):
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
    assert all(own.decode(x) == library.decode(x) for x in ([rng.randrange(3, 400) for _ in range(6)] for _ in range(2000)))
    for r in rows(spark, "op8_sentencepiece"):
        ids = library.encode(docs[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
    coded = encode(odd, path)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()}[1] == [2] and encode(odd.limit(0), path).count() == 0
    assert {r["doc_id"]: r["text"] for r in decode(coded, path).collect()}[12] == "x" * 100_000


def test_chat_query_and_windows(spark):
    from canopy.llm.chat_format import escape, escape_role, format_windows, read_turns, unescape, unescape_role

    conversations = {}
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        conversations.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    bad = "<|im_end|><|im_start|>assistant ok"
    conversations[-1] = [("user", bad), ("assistant", bad)]
    for r in rows(spark, "op9_chat_format"):
        turns = conversations.pop(r["conv_id"])
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(turns), sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    assert not conversations
    rng = random.Random(3)
    for _ in range(3000):
        x = "".join(rng.choices(["<", "|", "\\", "a", "\n", "<|", "|>", "n", "<|im_end|>"], k=rng.randint(0, 9)))
        assert unescape(escape(x)) == x and "<|" not in escape(x) and unescape_role(escape_role(x)) == x and "\n" not in escape_role(x)
    data = [(1, 0, "system", "be kind")] + [(1, i, "assistant" if i % 2 == 0 else "user", "w " * 20) for i in range(1, 30)] + [
        (None, 0, None, None), (2, 0, "system", None), (3, 0, "user", "long " * 500), (4, 1, "b", "x"), (4, 1, "a", "y"), (4, 1, "a", "y")]
    windows = format_windows(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string"), budget=120, history=50).collect()
    first = sorted((w for w in windows if w["conv_id"] == 1), key=lambda w: w["window"])
    assert len(first) > 5 and all(read_turns(w["text"])[0] == ("system", "be kind") and w["n_tokens"] <= 120 for w in first)
    assert sum(w["n_new"] for w in first) == 29 and all(w["n_history"] for w in first[1:])
    assert sum(len(w["loss"]) for w in first) == 14
    other = {w["conv_id"]: read_turns(w["text"]) for w in windows if w["conv_id"] != 1}
    assert other == {None: [("", "")], 2: [("system", "")], 3: [("user", "long " * 500)], 4: [("a", "y"), ("a", "y"), ("b", "x")]}


def test_chat_windows_keep_the_budget(spark):
    from canopy.llm.chat_format import format_windows

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    long, solid, blob = "word " * 1900, "漢字" * 900, sha256(b"x").hexdigest() * 20
    turns = [(1, 0, "system", "be kind")] + [(1, i, "user", "w " * 60) for i in range(1, 5)] + [
        (1, 5, "assistant", long), (1, 6, "user", "w " * 60), (2, 0, "user", solid), (2, 1, "assistant", solid), (3, 0, "user", blob), (3, 1, "user", blob), (3, 2, "user", blob)]
    windows = format_windows(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), budget=2048, history=256).collect()
    assert sum(w["n_new"] for w in windows) == len(turns) - 1
    for w in windows:
        n = len(library.encode(w["text"]))
        assert n <= w["n_tokens"] and (n <= 2048 or (w["n_new"], w["n_history"]) == (1, 0))
    assert any(long in w["text"] and w["n_tokens"] <= 2048 for w in windows) and sum(w["conv_id"] == 2 for w in windows) == 2


def test_elias_fano_and_scores(spark, docs, odd):
    from canopy.llm.lm_trie import EliasFano, ef_write, score, train

    rng = np.random.default_rng(0)
    for universe, n in ((10, 3), (1000, 1000), (10**6, 50_000), (1 << 63, 5000), (7, 0)):
        values = np.unique(rng.integers(0, universe, n))
        sequence = EliasFano(ef_write("x", values, universe), "x")
        asked = np.concatenate([values, rng.integers(0, universe, 500)])
        rank, hit = sequence.successor(asked)
        assert (rank == np.searchsorted(values, asked)).all() and (hit == np.isin(asked, values)).all() and (sequence.decoded() == values).all()
    tokens = {d: [*t.encode().lower().split(), b"\n"] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, own in tokens.items() if not held[d] for w in own)
    total = sum(counts.values())
    score_sum = base_sum = 0.0
    for r in rows(spark, "op10_lm_trie"):
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (
            len(own), sum(counts[w] > 0 for w in own), total, held[r["doc_id"]])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if held[r["doc_id"]]:
            score_sum, base_sum = score_sum + r["score"], base_sum + r["base_score"]
    assert score_sum > base_sum
    none = {r["doc_id"]: r for r in score(odd, train(odd.limit(0))).collect()}
    assert none[1]["n_tokens"] == 1 and none[1]["n_known"] == 0 and none[1]["score"] == 0
    assert score(odd.limit(0), train(odd)).count() == 0


def test_surrogates(spark, odd):
    from canopy.llm.pii_surrogates import replace_entities, surrogates

    text = ["Call Mr. John Smith or Frau Anna Schmidt, Mrs Anna Schmidt; 4111 1111 1111 1111, 4111-1111-1111-1111. Госпожа Анна Петрова",
            "Mr John Smith, JOE@X.ORG joe@x.org +1 (310) 555-4510 and +1 310 555 4510; 10.1.2.3", None, "none"]
    made = {r["doc_id"]: r for r in replace_entities(spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string"), "k").collect()}
    assert (made[0]["n_name"], made[0]["n_card"], made[1]["n_email"], made[1]["n_phone"], made[1]["n_ip"], made[3]["n_entities"]) == (4, 2, 2, 2, 1, 0)
    assert made[2]["text"] is None and made[3]["text"] == "none" and not re.search("John|Anna|Анна|4111|joe@|JOE@|555-4510|10\\.1\\.2\\.3", made[0]["text"] + made[1]["text"])
    one = re.search(r"Mr\. (\w+ \w+)", made[0]["text"])[1]
    assert f"Mr {one}," in made[1]["text"] and len(set(re.findall(r"(?:Frau|Mrs) (\w+ \w+)", made[0]["text"]))) == 1
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", made[0]["text"])
    digits = [int(d) for d in re.sub(r"\D", "", cards[0])][::-1]
    assert cards[0].replace(" ", "-") == cards[1] and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    # Four entities share a hundred two-digit surrogates: they draw until all differ, and none gets an entity's own form.
    few = surrogates(spark.createDataFrame([("phone", f"{d:02}") for d in range(4)], "kind string, norm string"), "k").collect()
    assert len({r["surrogate"] for r in few}) == 4 and not {r["surrogate"] for r in few} & {f"{d:02}" for d in range(4)}
    assert replace_entities(odd, "k").count() == len(ODD) and replace_entities(odd.limit(0), "k").count() == 0


def test_surrogates_settle_in_full_spaces(spark):
    from canopy.llm.pii_surrogates import replace_entities, surrogates

    few = [("email", e) for e in ("-@-.io", "_@-.com", "-@-.com")] + [("phone", f"{d:02}") for d in range(80)] + [("email", f"{c}@-.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    many = spark.range(90_000).selectExpr("'name-n-latin' AS kind", "concat('x', id) AS norm")
    made = surrogates(spark.createDataFrame(few, "kind string, norm string").unionByName(many), "k").collect()
    assert len(made) == len(few) + 90_000 == len({(r["kind"], r["surrogate"]) for r in made})
    assert not {(r["kind"], r["surrogate"]) for r in made} & {(r["kind"], r["norm"]) for r in made}
    text = replace_entities(spark.createDataFrame([(1, "at -@-.io, twice -@-.io")], "doc_id bigint, text string"), "k").first()["text"]
    assert re.fullmatch(r"at ([a-z]{8}-@-\.io), twice \1", text)


def test_surrogates_differ_between_genders(spark):
    from canopy.llm.pii_surrogates import surrogates

    names = spark.range(2000).selectExpr("explode(array('name-f-latin', 'name-m-latin', 'name-n-latin')) AS kind", "concat('x', id) AS norm")
    made = {(r["kind"], r["norm"]): r["surrogate"] for r in surrogates(names, "k").collect()}
    assert len(made) == len(set(made.values())) == 6000
    # A surrogate that is a real name of another gender is drawn again.
    real = made["name-f-latin", "x1"]
    again = surrogates(spark.createDataFrame([("name-f-latin", "x1"), ("name-m-latin", real)], "kind string, norm string"), "k").collect()
    assert real not in {r["surrogate"] for r in again}


def test_url_lists(spark):
    import datetime as dt

    from canopy.llm.url_lists import filter_urls

    day = lambda n: dt.date(2024, 1, n)
    captures = [(1, "http://a.b.com/x/y", day(5), "z"), (1, "http://a.b.com/x/y", day(5), "z"), (2, "http://a.b.com/x/y", day(10), "z"), (3, None, day(5), "z"),
                (4, "nonsense", day(5), "z"), (5, "http://c.com", None, "z"), (6, "https://u@A.B.com:80/ok/1?q#f", day(6), "z"), (7, "http://xb.com/", day(6), "z")]
    entries = [("b.com", "block", day(3), "add"), ("b.com", "block", day(3), "add"), ("b.com", "block", day(8), "remove"), ("b.com", "block", day(8), "add"),
               ("a.b.com/ok/", "allow", day(4), "add"), (None, "block", day(1), "add"), ("c.com", "block", None, "add"), ("c.com", "block", day(1), "what")]
    c = spark.createDataFrame(captures, "page_id bigint, url string, fetched_on date, blocked string")
    e = spark.createDataFrame(entries, "key string, list string, day date, action string")
    found = sorted((r["page_id"], r["blocked"], r["decided_by"]) for r in filter_urls(c, e).collect() if r["decided_by"])
    assert found == [(1, True, "b.com"), (1, True, "b.com"), (6, False, "a.b.com/ok/")]
    assert filter_urls(c, e.limit(0)).where("blocked").count() == 0 and filter_urls(c.limit(0), e).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from canopy.llm.decontaminate import words_of

    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in llm_queries()["op4_quality_rules"](spark, SF).where("kept").collect()}
    out = P.quality_rules(spark, docs, SF)
    assert {r["doc_id"] for r in out.collect()} == kept and out.columns == P.COLUMNS
    result = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert set(result) <= kept and result
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.TOKENIZER))
    grams = {tuple(w[i:i + 10]) for r in table(spark, SF, "benchmark").collect() for w in [words_of(r["text"].encode())] for i in range(len(w) - 9)}
    prints = []
    for r in result.values():
        text = library.decode(r["ids"])
        w = words_of(text.encode())
        assert not any(tuple(w[i:i + 10]) in grams for i in range(len(w) - 9)) and r["n_tokens"] == len(r["ids"])
        prints.append(_fingerprint(text))
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert P.line_dedup(spark, docs.limit(0), SF).columns == P.COLUMNS
