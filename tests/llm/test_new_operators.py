"""URL filters, spelling variants and collocations against brute-force versions on small tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightloom.llm import oracle, phrases, spelling, url_filters
from nightloom.llm.url_filters import Rule

DOCS = "doc_id long, text string, lang string, word string, n string, key string"


def docs_of(spark, texts, langs=None, ids=None):
    """doc_id, text, lang and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(ids[i] if ids else i, t, langs[i % len(langs)] if langs else "en", "x", "y", "z") for i, t in enumerate(texts)], DOCS)


# ---- URL filters ------------------------------------------------------------------------------------
PAGES = "page_id long, url string, host string, rule string, label string"


def pages_of(spark, urls, first=0):
    return spark.createDataFrame([(first + i, u, "x", "y", "z") for i, u in enumerate(urls)], PAGES)


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


URLS = [
    None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "https://Example.com/en/1", "http://www.example.com/en/2", "http://m.www.example.com/en/3", "http://notexample.com/en/4",
    "http://x.net/es/", "http://x.net/es", "http://NET/fr/x", "ftp://a.org?u=http://b.com/", "x://y://z/en/", "http://a.org#f?g", "http://ü.net/fr/é?a=1&b=2#c", "http://a.org/a\nb/c", "http://a.org/" + "q" * 20000 + "?x=1", "http://" + "h" * 5000 + ".com/",
]


def test_url_parts_and_rules(spark):
    out = {r.page_id: r for r in url_filters.judge(pages_of(spark, URLS)).collect()}
    for i, u in enumerate(URLS):
        host, path = brute_parts(u)
        rule = brute_rule(host, path, url_filters.RULES)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule and rule.text), u
        assert out[i].verdict == rule.verdict if rule else out[i].verdict in ("allow", "block")


def test_longest_rule_wins_over_the_host(spark):
    rules = (Rule("block", "b.com", "/"), Rule("allow", "a.b.com", "/x"), Rule("block", "a.b.com", "/x/y"))
    got = [r.verdict for r in url_filters.judge(pages_of(spark, ["http://a.b.com/x/y", "http://a.b.com/x/", "http://a.b.com/z", "http://c.a.b.com/x"]), rules).orderBy("page_id").collect()]
    assert got == ["block", "allow", "block", "allow"]


@pytest.mark.parametrize("urls,rules,want", [
    ([], url_filters.RULES, []),
    (["http://a.org/", None], (), ["allow", "allow"]),
    (["http://a.org/", "http://b.net/fr/"], (Rule("block", "net", "/"),), ["block", "block"]),
    (["http://a.org/", "http://b.com/"], (Rule("allow", "com", "/"),), ["allow", "allow"]),
])
def test_url_filters_without_two_labels(spark, urls, rules, want):
    assert [r.verdict for r in url_filters.judge(pages_of(spark, urls), rules).orderBy("page_id").collect()] == want


def brute_fit(bins, labels, trees, depth):
    """The same trees by NumPy: gradients in whole units, ties by feature and bin."""
    unit, smooth, rate = url_filters.UNIT, url_filters.SMOOTH, url_filters.RATE
    base = math.log(labels.sum() / (len(labels) - labels.sum()))
    score = np.full(len(labels), base)
    gain = lambda g, h: g * g / (h + smooth * unit)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g = np.floor(np.abs((labels - p) * unit) + 0.5).astype(np.int64) * np.sign(labels - p).astype(np.int64)
        h = np.maximum(np.floor(p * (1 - p) * unit + 0.5).astype(np.int64), 1)

        def grow(rows, level):
            g_all, h_all = int(g[rows].sum()), int(h[rows].sum())
            best, at = 0.0, None
            for f in range(bins.shape[1]) if level < depth else ():
                for b in sorted(set(bins[rows, f]))[:-1]:
                    left = rows[bins[rows, f] <= b]
                    gl, hl = int(g[left].sum()), int(h[left].sum())
                    if min(hl, h_all - hl) < unit // 2:
                        continue
                    got = gain(gl, hl) + gain(g_all - gl, h_all - hl) - gain(g_all, h_all)
                    if got > best + 1e-9 * unit:
                        best, at = got, (f, b)
            if at is None:
                score[rows] += rate * g_all / (h_all + smooth * unit)
                return
            low = bins[rows, at[0]] <= at[1]
            grow(rows[low], level + 1)
            grow(rows[~low], level + 1)

        grow(np.arange(len(labels)), 0)
    return score


def test_trees_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 6, (300, 4))
    labels = ((bins[:, 0] > 2) ^ (bins[:, 1] > 3)).astype(int)
    labels[:20] = 1 - labels[:20]
    rows = spark.createDataFrame([(i, [int(x) for x in b], int(y), 1) for i, (b, y) in enumerate(zip(bins, labels))], "i int, bins array<int>, label int, weight long")
    model = url_filters.fit(rows, 4, trees=6, depth=3)
    got = np.array([r[0] for r in rows.select("i", url_filters.raw_score(model, F.col("bins")).alias("s")).orderBy("i").select("s").collect()])
    assert np.allclose(got, brute_fit(bins, labels, 6, 3), atol=1e-9)
    merged = rows.drop("i").groupBy("bins", "label").agg(F.sum("weight").alias("weight"))
    assert url_filters.fit(merged, 4, trees=6, depth=3) == model  # equal rows with a weight teach the same


def test_trees_tell_unseen_urls(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(4, 8)))
    bad = lambda d: f"http://{word()}{rng.randint(1000, 99999)}-{word()}{rng.randint(10, 999)}.{d}/{rng.randint(10**6, 10**8)}/{rng.randint(10**4, 10**6)}?id={rng.randint(1, 10**6)}&s={rng.randint(1, 99)}"
    good = lambda d: f"https://www.{word()}.{d}/{word()}/{word()}.html"
    urls = [bad("bad") for _ in range(150)] + [good("good") for _ in range(150)] + [bad("x") for _ in range(100)] + [good("x") for _ in range(100)]
    rules = (Rule("block", "bad", "/"), Rule("allow", "good", "/"))
    got = [r.verdict for r in url_filters.judge(pages_of(spark, urls), rules).orderBy("page_id").collect()]
    right = sum(v == w for v, w in zip(got[300:], ["block"] * 100 + ["allow"] * 100))
    assert right >= 190
    again = [r.verdict for r in url_filters.judge(pages_of(spark, urls).repartition(7), rules).orderBy("page_id").collect()]
    assert again == got  # the order of rows doesn't matter


def test_url_entropy(spark):
    texts = ["", "a", "aaaa", "abab", "abcd", "ünïü", "a" * 100000 + "b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(url_filters.entropy(F.col("t"))).collect()]
    for t, g in zip(texts, got):
        counts = collections.Counter(t)
        assert abs(g - (-sum(c / len(t) * math.log2(c / len(t)) for c in counts.values()) if t else 0)) < 1e-9


def test_url_repeats_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "http://a.com/"), (1, "http://b.org/x"), (1, "http://b.org/x"), (2, "http://c.net/fr/1")], "page_id long, url string")
    out = url_filters.judge(rows).collect()
    assert len(out) == 4 and len({(r.verdict, r.score) for r in out if r.page_id == 1}) == 1


# ---- spelling variants ------------------------------------------------------------------------------
def brute_words(rows, least_length=6, least_count=5, slips=True):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(n, times=5):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= times * n[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return {(a, form[a], root(a), n[a], len(near[a]), n[form[a]] if form[a] else None) for a in n}


@pytest.mark.parametrize("block", [3, 64])
def test_spelling_variants(spark, block):
    """A dense dictionary over few letters; small blocks are subdivided again and again."""
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abÀé") for _ in range(rng.randint(5, 8))) for _ in range(400)) for _ in range(12)]
    stems = ["colour", "harbour", "neighbour", "éclairÉ", "straßeÜ"]
    texts += [" ".join([s] * 60 + [s[:k] + s[k + 1 :] for k in range(len(s))] * 6 + [s.upper()] * 5 + [s + "x"] * 8 + [s[:2] + "q" + s[3:]] * 7) for s in stems]
    texts += [None, "", "  ", "short", "a" * 5000, ("z" * 3000 + " ") * 6, ("z" * 3001 + " ") * 40, "same same twelve twelve twelve twelve twelve"] + ["repeat row words here"] * 6
    rows = list(enumerate(texts))
    rows[-1] = (None, rows[-1][1])
    df = docs_of(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = {tuple(r) for r in spelling.spelling_variants(df, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants(brute_words(rows))


def test_near_pairs_once_whatever_the_block(spark):
    words = ["".join(x) for x in __import__("itertools").product("ab", repeat=6)] + ["".join(x) for x in __import__("itertools").product("ab", repeat=7)] + ["c" * 6, "c" * 7, "c" * 8]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if one_edit(a, b)}
    for block in (2, 10**6):
        got = [(r.a, r.b) for r in spelling.near_pairs(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_forms_are_followed_to_the_last(spark):
    chain = {"walker": 5, "walkers": 25, "walkerss": 125, "walkersss": 625, "walkerssss": 3125}
    found = spelling.roots(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).transform(lambda d: d))
    assert {r.word: r.root for r in found.collect()} == {w: "walkerssss" for w in chain}


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0
    assert spelling.spelling_variants(docs_of(spark, [None, "", "one two three"])).count() == 0


# ---- collocations -----------------------------------------------------------------------------------
def brute_counts(rows, longest):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f, n


def brute_collocations(rows, least, longest, first):
    f, n = brute_counts(rows, longest)
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        scored = []
        for p, a in often.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * c >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:first])]  # noqa: E741
    return sorted(out)


def test_collocations(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MERGE", 500)  # sums are handed on often
    rng = random.Random(2)
    vocab = ["the", "of", "New", "york", "é", "Ü", "a", "b-c", "d'e"]
    line = "permission is hereby granted to all"
    texts = [" ".join(rng.choice(vocab) for _ in range(150)) + rng.choice([". ", "\n", "; "]) + line + ("" if i % 2 else " people") for i in range(60)]
    texts += [None, "", " \t ", ".,;:!?", "one", "the of", "a a a a a a a a", "x" * 3000, "New\tYork new  york\vNEW york"] + ["same row of words"] * 12
    langs = ["en", "fr", None, "en"]
    rows = [(t, langs[i % 4]) for i, t in enumerate(texts)]
    want = brute_collocations(rows, 10, 5, 50)
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = sorted(tuple(r) for r in phrases.collocations(docs_of(spark, texts, langs).repartition(5), least=10, first=50).select(*cols).collect())
    assert got == want and len(want) > 100
    assert got == sorted(tuple(r) for r in phrases.collocations(docs_of(spark, texts, langs).coalesce(1), least=10, first=50).select(*cols).collect())


def test_collocations_of_pairs_only(spark):
    texts = ["a b c d"] * 10
    got = phrases.collocations(docs_of(spark, texts), least=5, longest=2).collect()
    assert {r.phrase for r in got} == {"a b", "b c", "c d"} and {r.score for r in got} == {4000}


def test_no_collocations(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [None, "", "a b"])).count() == 0


def test_grown_prefixes_cross_batches():
    """A prefix whose projections lie in several batches is summed over all of them."""
    rows = [("en", 1, 2, 3, 0, 0, 2), ("en", 1, 2, 3, 4, 0, 3), ("en", 1, 2, 3, 4, 5, 4), ("en", 1, 2, 3, 4, 6, 1), ("en", 1, 2, 4, 0, 0, 9), ("fr", 1, 2, 4, 4, 4, 5)]
    names = ["lang", "h1", "h2", "h3", "h4", "h5", "n"]
    for size in (1, 2, 3, 6):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + size]]) for i in range(0, 6, size)]
        got = sorted(tuple(r.values()) for b in phrases._grow(4, 5)(iter(batches)) for r in b.to_pylist())
        assert got == sorted([("en", 1, 2, 3, 4, 0, 8), ("en", 1, 2, 3, 4, 5, 4), ("fr", 1, 2, 4, 4, 0, 5), ("fr", 1, 2, 4, 4, 4, 5)])


def test_rows_of_counts_grow_with_the_text(spark, monkeypatch):
    """Five times the text makes every pair frequent: no count makes more rows for that than for the text."""
    rng, made, asked = random.Random(5), [], []
    real = type(spark.range(1)).mapInArrow

    def watched(df, run, schema, *more):
        out = real(df, run, schema, *more)
        if "text" in df.columns:
            asked.append((schema, out))
        return out

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", watched)
    for n in (100, 500):
        asked.clear()
        texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)) for _ in range(n)]
        phrases.frequent_phrases(docs_of(spark, texts).coalesce(1))
        made.append({schema: out.count() for schema, out in asked if "h1" in schema})
    assert made[1] and all(v <= 12 * made[0][k] for k, v in made[1].items()), made


def test_pairs_of_common_words_are_summed_over_tasks(spark, monkeypatch):
    """A pair of two common words is dealt by the word after it: its parts, all below the least count, are added up."""
    texts = [f"the of {chr(97 + i)}{chr(97 + k)}" for i in range(26) for k in range(5)] * 3 + ["the of"] * 2
    for often in (phrases.OFTEN, 1):  # spread, not spread
        monkeypatch.setattr(phrases, "OFTEN", often)
        got = phrases.collocations(docs_of(spark, texts).repartition(5), least=3, first=500).collect()
        assert {r.phrase: r.a for r in got}["the of"] == 392 and sum(r.a == 3 for r in got) == 130


def test_sums_hand_on_rare_rows_first(monkeypatch):
    """A row that comes again and again stays until the end; nothing is lost."""
    monkeypatch.setattr(phrases, "MERGE", 64)
    sums = phrases._Sums(["lang", "h", "f"], keep=True)
    lang = sums.codes(pa.array(["en"] * 41))
    out = [b for i in range(50) for b in sums.add([lang, np.array([0, *range(40 * i + 1, 40 * i + 41)])], np.ones(41, dtype=np.int64))]
    rows = [(r["h"], r["f"]) for b in [*out, *sums.out()] for r in b.to_pylist()]
    assert rows.count((0, 50)) == 1 and sorted(h for h, _ in rows) == list(range(2001))


def test_words_of_equal_hash_get_another_seed(spark, monkeypatch):
    seeds = []
    real = phrases._count_words

    def clashing(seed):
        seeds.append(seed)
        run = real(seed)
        return (lambda batches: (phrases.pa.RecordBatch.from_arrays([b.column(0), phrases.pa.array([7] * b.num_rows, phrases.pa.int64()), b.column(2), b.column(3)], names=["lang", "h", "f", "word"]) for b in run(batches))) if seed == 0 else run

    monkeypatch.setattr(phrases, "_count_words", clashing)
    got = phrases.collocations(docs_of(spark, ["a b c"] * 5), least=5)
    assert [r.phrase for r in got.collect()] == ["a b c"] and seeds == [0, 1]


def test_scores_pass_64_bits(spark):
    a, n, l, r = 10**12 - 7, 10**16 - 3, 10**13 + 1, 10**12 + 9  # noqa: E741
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(phrases.cut_score(*[F.col(c) for c in "anlr"])).first()[0] == 1000 * a * n // (l * r)


def test_sql_of_new_operators_is_there():
    assert "levenshtein" in oracle.OP12 and "HUGEINT" in oracle.OP13
