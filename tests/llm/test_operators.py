"""Every operator on odd rows, clashing columns and empty tables, and against
brute force on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from lendframe.llm import decontam, fingerprints, language, lines, mixing, ngram_join, quality, secret_scan, sharding, tokens
from lendframe.llm import common
from lendframe.llm import shingles as S

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture()
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three"), (2, "the same words again and again and again in one line and more words"), (3, None), (4, "")], "item_id long, text string")


def run_all(spark, docs, benchmark, vocabulary):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (5, 1, 0), (None, 1, 0)], LABELS)
    return {
        "lines": lines.dedup_lines(docs),
        "classes": ngram_join.jaccard_classes(docs),
        "language": language.predict_language(docs, language.fit_language_model(docs)),
        "shards": sharding.shuffle_into_shards(docs, 3),
        "tokens": tokens.count_tokens(docs, vocabulary),
        "contamination": decontam.find_contamination(docs, benchmark),
        "mixing": mixing.mix_sources(docs, labels),
        "fingerprints": fingerprints.fingerprints_with_edits(docs),
        "quality": quality.score_quality(docs, labels),
    }


def test_odd_rows_one_result_row_each(spark, odd, clashing, benchmark, vocabulary):
    n = odd.count()
    plain = {k: [tuple(r) for r in df.collect()] for k, df in run_all(spark, odd, benchmark, vocabulary).items()}
    assert {k: len(v) for k, v in plain.items()} == {k: n for k in plain}
    wide = run_all(spark, clashing, benchmark, vocabulary)
    for name, df in wide.items():
        if name != "shards":
            assert collections.Counter(map(repr, plain[name])) == collections.Counter(repr(tuple(r)) for r in df.collect()), name
    shards = wide["shards"].collect()
    assert len(shards) == n and {type(r.shard) for r in shards} == {int} and shards[0].m == {"a": 1}


def test_empty_tables(spark, empty, benchmark, vocabulary):
    for name, df in run_all(spark, empty, benchmark, vocabulary).items():
        assert df.collect() == [], name
    assert secret_scan.scan_secrets(empty).collect() == []
    assert fingerprints.near_duplicates(empty).collect() == []


def test_empty_benchmark(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, len(r.item_ids)) for r in decontam.find_contamination(odd, none).collect()} == {(0, 0)}


def test_defined_results_of_odd_rows(spark, odd, benchmark, vocabulary):
    out = {k: df.collect() for k, df in run_all(spark, odd, benchmark, vocabulary).items()}
    by = lambda name: {r.doc_id: r for r in out[name]}
    assert by("lines")[1].text == "" and by("lines")[1].n_lines == 1 and by("lines")[3].n_lines == 3
    c = by("classes")
    assert (c[1].n_shingles, c[1].component_id) == (0, 1) and (c[3].n_shingles, c[3].component_id) == (0, 3)
    assert c[5].component_id == c[6].component_id == 5 and c[None].component_id is None and c[None].n_shingles > 0
    lang = by("language")
    assert [lang[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and lang[4].score == 0
    assert by("tokens")[1].n_tokens == 0 == by("tokens")[1].n_bytes
    d = by("contamination")
    assert d[5].item_ids == ["1"] and d[5].n_hit == d[5].n_words == 3 and d[1].n_words == 0
    f = by("fingerprints")
    assert f[7].fingerprint == f[7].fingerprint and bytes(f[1].fingerprint) == b"\xff" * 128 and f[5].fingerprint == f[6].fingerprint


def test_long_text_is_read_whole(make, benchmark, vocabulary):
    """A text longer than every block, whose last words matter."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(120_000)]
    text = " ".join(words) + " one two three"
    docs = make([(1, text, "en", "a", len(text)), (2, text, "en", "a", len(text))])
    r = decontam.find_contamination(docs, benchmark).collect()
    assert {(x.n_words, x.n_hit, tuple(x.item_ids)) for x in r} == {(120_003, 3, ("1",))}
    w, o = S.Words(S.SPACE)([text.encode()])
    assert o[1] == 120_003 and len(set(w.tolist())) == len(set(text.split()))
    c = ngram_join.jaccard_classes(docs).collect()
    everything = [*words, "one", "two", "three"]
    assert {x.n_shingles for x in c} == {len({tuple(everything[i: i + 4]) for i in range(len(everything) - 3)})}
    assert {x.component_id for x in c} == {1}


# --- words and shingles --------------------------------------------------------


def brute_shingles(words, k):
    return [tuple(words[i: i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


@pytest.mark.parametrize("separators,pattern", [(S.SPACE, rb"[^\x20\x09-\x0D]+"), (S.NON_WORD, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_and_shingles_equal_brute_force(separators, pattern):
    rng = random.Random(1)
    raw = ["".join(rng.choices("abAB 1\t\n.é漢-", k=rng.randint(0, 60))).encode() for _ in range(300)]
    words, offsets = S.Words(separators)(raw)
    names = {}
    for k in (1, 3, 5):
        values, bounds = S.shingles(words, offsets, k)
        for i, t in enumerate(raw):
            expect = brute_shingles(re.findall(pattern, t.lower()), k)
            got = values[bounds[i]: bounds[i + 1]].tolist()
            assert len(got) == len(expect)
            for g, e in zip(got, expect):
                assert names.setdefault((k, g), e) == e
    assert len(names) == len({(k, e) for (k, _), e in names.items()})


def test_ascii_lower_equals_translate_on_every_character(spark):
    points = [p for p in range(1, 0x30000) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([("xY" + chr(p) + "Z",) for p in points], "t string")
    table = str.maketrans(common.ASCII_UPPER, common.ASCII_LOWER)
    bad = [r.t for r in df.select("t", common.ascii_lower(F.col("t")).alias("low")).collect() if r.low != r.t.translate(table)]
    assert not bad


# --- joins against brute force ---------------------------------------------------


def near_copies(rng, n_groups=6, size=14, words=60):
    rows, vocabulary = [], ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    for g in range(n_groups):
        base = rng.choices(vocabulary, k=words + g * 15)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6, 12])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i * 3 + 1, t, "en", "s", len(t)) for i, t in enumerate(rows)]


def brute_components(sets, linked):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and linked(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 8, 10)])
def test_ngram_join_equals_all_pairs(make, k, num, den):
    from fractions import Fraction
    rows = near_copies(random.Random(k))
    sets = {r[0]: set(brute_shingles(r[1].split(), k)) for r in rows}
    expect = brute_components(sets, lambda a, b: den * len(a & b) >= num * len(a | b))
    got = ngram_join.jaccard_classes(make(rows), k, Fraction(num, den)).collect()
    assert {r.doc_id: r.component_id for r in got} == expect
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert 6 < len(set(expect.values())) < len(rows)


def test_matches_asked_for_never_lose_a_pair():
    """The prefix lemma for every number of matches, on random sets."""
    rng = random.Random(9)
    for _ in range(300):
        base = rng.sample(range(400), 40)
        a, b = (sorted(set(base[rng.randint(0, 5):]) | set(rng.sample(range(400), rng.randint(0, 4)))) for _ in range(2))
        if 100 * len(set(a) & set(b)) < 85 * len(set(a) | set(b)):
            continue
        prefix = lambda s, m: set(s[: len(s) - -(-85 * len(s) // 100) + m])
        for la in range(1, 5):
            for lb in range(1, 5):
                assert len(prefix(a, la) & prefix(b, lb)) >= min(la, lb)


def test_components_of_a_path_and_a_star(spark):
    from lendframe.llm.components import connected_components
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1100)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(path + star + [(5, 5)], "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(1000, 1100)}}


def test_near_duplicates_are_exact_and_found(make):
    rows = near_copies(random.Random(2))
    sets = {r[0]: set(brute_shingles(r[1].split(), 5)) for r in rows}
    got = fingerprints.near_duplicates(make(rows)).collect()
    for r in got:
        assert r.jaccard == pytest.approx(len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) and r.jaccard >= 0.8
    copies = {i for i in sets for j in sets if i < j and sets[i] == sets[j]}
    assert copies <= {x for r in got for x in (r.a, r.b)}


def test_decontamination_equals_brute_force(spark, make):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 12, 13, 14, 30])))) for i in range(40)]
    items += [(100, items[-1][1]), (101, "W1, w2! W3")]
    rows = []
    for i in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(items)[1].split()
        rows.append((i, " ".join(w), "en", "s", 0))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(t.lower())
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[p: p + n])].add(str(i))
    got = {r.doc_id: r for r in decontam.find_contamination(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t, *_ in rows:
        w, hit, found = word.findall(t.lower()), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if own := windows.get(tuple(w[p: p + n])):
                    hit |= set(range(p, p + n))
                    found |= own
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), len(hit), sorted(found)), t


# --- the others --------------------------------------------------------------------


def test_shards_hold_everything_evenly(make):
    rows = [(i, "x" * (i % 50) * 40, "en", "s", 0) for i in range(997)] + [(1, "x" * 40, "en", "s", 0)] * 30
    out = sharding.shuffle_into_shards(make(rows), 24, bucket_bytes=20_000).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter((r[0], r[1]) for r in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.2


def test_written_shards_read_back(spark, make, tmp_path):
    docs = make([(i, f"text {i}", "en", "s", 6) for i in range(100)])
    sharding.write_shards(sharding.shuffle_into_shards(docs, 4), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 4


@pytest.mark.parametrize("sizes", [[100, 1, 1, 1], [5, 5, 5, 5, 5], [0, 0, 10], [1, 1000, 3, 7, 7, 0, 12], [0, 0]])
def test_targets_equal_repeated_sharing(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, size long")).collect()}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    most, full, total = {n: 3 * s for n, s in zip(names, sizes)}, set(), sum(sizes)
    while True:
        free = [n for n in names if n not in full]
        if not free:
            break
        level = (total - sum(most[n] for n in full)) / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > most[n]]
        if not over:
            break
        full |= set(over)
    expect = {n: most[n] if n in full else level * weight[n] for n in names}
    assert got == pytest.approx(expect)


def test_mix_comes_near_its_targets(make):
    rows = [(i, "w " * (i % 37 + 1), "en", f"s{min(i % 10, 4)}", 0) for i in range(3000)]
    out = mixing.mix_sources(make(rows)).collect()
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 37
    again = mixing.mix_sources(make(rows).repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}


def test_better_documents_are_taken_more_often(spark, make):
    rows = [(i, "w " * 10, "en", "b" if i % 2 else "a", 0) for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 4 < 2), 0) for i in range(4000)], LABELS)
    out = [r for r in mixing.mix_sources(make(rows), labels).collect() if r.source == "b"]
    good, bad = (np.mean([r.taken for r in out if (r.doc_id % 4 < 2) == g]) for g in (True, False))
    assert good > 1.2 * bad


def test_token_counts_equal_the_library(make, vocabulary):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary)
    rng = random.Random(6)
    alphabet = [*"abcdeABC '’.,!-_0123 \n\t\r", "é", "ß", "漢", "字", "́", "²", "Ⅷ", "½", "\xa0", " ", "\x1c", "\x85", "😀", "'ll", "'s", "<|endoftext|>", " the", "    "]
    samples = ["", "<|endoftext|>", "a<|endoftext|>b", " ", "'", "x" * 300] + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(600)]
    got = {r.doc_id: r for r in tokens.count_tokens(make([(i, t, "en", "s", 0) for i, t in enumerate(samples)]), vocabulary).collect()}
    for i, t in enumerate(samples):
        assert got[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids), repr(t)
        assert got[i].n_bytes == len(t.encode())


def test_fingerprints_follow_the_edit_rule(make):
    rng = random.Random(8)
    rows = [(i * 7, " ".join(rng.choices(["ab", "cdé", "efg", "hij", "k", "漢字"], k=rng.randint(0, 60))), "en", "s", 0) for i in range(90)]
    got = {r.doc_id: r for r in fingerprints.fingerprints_with_edits(make(rows).repartition(5)).collect()}
    order = sorted(rows, reverse=True)
    for r, following in zip(order, order[1:] + order[:1]):
        n = len(r[1]) // 3
        edited = r[1][: len(r[1]) - n] + following[1][:n]
        own = got[r[0]]
        assert own.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and own.n_chars == len(r[1])
        a, b = (set(brute_shingles(t.encode().lower().split(), 5)) for t in (r[1], edited))
        if len(a) > 20:
            assert abs(own.near_edited - len(a & b) / len(a | b)) < 0.3


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language.fit_language_model(docs)
    found = language.predict_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(common.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert (model["weights"] == 0).mean() > 0.3  # the penalties leave it sparse
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_long_text_counts_equal_its_pieces():
    text = "".join(random.Random(5).choices("abcdé ", k=language._CHARS * 2 + 77))
    whole = collections.Counter(text[i: i + n] for n in language.ORDERS for i in range(len(text) - n + 1))
    assert language.gram_counts([text, "ab"])[0].sum() == sum(whole.values())
    np.testing.assert_array_equal(language.gram_counts(["ab"])[0], language.gram_counts([text, "ab"])[1])


def test_quality_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_gam(x, y, rounds=20)
    assert (1, 0) in model["pairs"]
    assert ((quality.score_gam(model, x) > 0.5) == y).mean() > 0.9


def test_secrets_found_and_words_left(make):
    rng = random.Random(11)
    rows, planted = [], set()
    for i in range(300):
        text = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 18))) for _ in range(40))
        if i % 10 == 0:
            key = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
            planted.add((i, len(text) + 1))
            text += " " + key + " end"
        if i % 15 == 1:
            planted.add((i, len(text) + 10))
            text += " password=" + "".join(rng.choices("0123456789abcdef", k=18)) + " end"
        rows.append((i, text, "en", "s", 0))
    out = secret_scan.scan_secrets(make(rows)).collect()
    assert {(r.doc_id, r.start) for r in out if r.is_secret} == planted
    assert any(not r.is_secret for r in out)


def test_forest_trained_on_given_findings(make):
    docs = make([(i, f"path /usr/share/lib{i}/python/module and id {i:032x} here", "en", "s", 0) for i in range(200)])
    found = secret_scan.findings(docs).withColumn("label", F.when(F.col("value").startswith("/usr"), 0.0).otherwise(1.0))
    out = secret_scan.scan_secrets(docs, found.where("doc_id < 100")).collect()
    assert all(r.is_secret != r.value.startswith("/usr") for r in out)


def test_secrets_found_in_a_session_that_observed_metrics(spark, make):
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    docs = make([(i, f"path /usr/share/lib{i}/python/module and id {i:032x} here", "en", "s", 0) for i in range(200)])
    found = secret_scan.findings(docs).withColumn("label", F.when(F.col("value").startswith("/usr"), 0.0).otherwise(1.0))
    assert not secret_scan.fit_forest(found).hasSummary
    assert all(r.is_secret != r.value.startswith("/usr") for r in secret_scan.scan_secrets(docs, found).collect())


def test_token_counts_equal_the_library_around_every_change_of_class(vocabulary):
    from tokenizers import Tokenizer
    spec = tokens.load_vocabulary(vocabulary)
    count, library = tokens.TokenCounter(spec), Tokenizer.from_file(vocabulary)
    edges = {p + d for c in spec["classes"].values() for r in c for p in r for d in (-1, 0, 1)}
    edges |= {0xA7CB, 0x16D40, 0x10D40, 0x85, 0xA0, 0x2028, 0x3000}
    points = sorted(p for p in edges if 0 <= p <= 0x10FFFF and not 0xD800 <= p < 0xE000)
    texts = [c.format(chr(p)) for p in points for c in ("{}", "{}'t", " {}", "1{}", "{}.")]
    encoded = library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, encoded) if count(t) != len(e.ids)] == []
