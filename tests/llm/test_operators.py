"""The training-data operators against brute force, and their edge cases."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, decontaminate, flat_files, lang_id, licenses, lm_score, mixing, near_dup, quality, queries, token_counts, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, component_id string, row string, size string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies at both sides of the limit, nulls, empty and very long texts, a repeated row, clashing columns."""
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 400, 300)]
    texts = [" ".join(base)] * 4
    for n in (1, 3, 6, 9, 12, 20, 40):
        other = list(base)
        for i in rng.choice(300, n, replace=False):
            other[i] = f"x{i}"
        texts.append(" ".join(other))
    texts += ["", None, "one", "One", "two words", "a b c", "a b c d", " \t\n", "é ñ 中文 text", " ".join(f"long{i % 5000}" for i in range(60000))]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 0, "x", "y", "z", "q") for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[0], "en", None, 0, "x", "y", "z", "q")]
    return spark.createDataFrame(rows, DOCS)


def brute_components(rows, k):
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], k)
    got = near_dup.near_duplicates(docs, k=k).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_near_duplicates_in_large_families(spark):
    """Chains of edits, with many pairs on both sides of the limit and several blocks' members in a bucket."""
    rng = np.random.default_rng(5)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 60)] for _ in range(2)]
    while len(texts) < 700:
        other = list(texts[rng.integers(max(0, len(texts) - 200), len(texts))])
        other[rng.integers(0, 60)] = f"n{len(texts)}"
        texts.append(other)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    want = brute_components(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_of_many_sizes_in_one_bucket(spark, monkeypatch):
    """Nested sets share buckets at all sizes; blocks of few members and shingles lose no link."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(i, " ".join(base[: int(n)])) for i, n in enumerate(rng.integers(20, 300, 160))]
    rows += [(1000 + i, " ".join([*base[:100], *[f"x{rng.integers(0, 10**6)}" for _ in range(int(n))]])) for i, n in enumerate(rng.integers(0, 60, 80))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    want = brute_components(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


def test_blocks_link_like_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64) << np.uint64(40)) for _ in range(40)]
    group = [(i, i, near_dup.min_hashes(s)[128:].astype(np.uint16).tobytes(), s.tobytes()) for i, s in enumerate(sets)]
    links = near_dup._links(group, group, True, 50, [0] * near_dup.BATCHES)
    up = list(range(40))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    for a in range(40):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 50 * (len(sets[a]) + len(sets[b]) - both):
                assert find(a) == find(b)
    assert len(links) < 40


def test_languages(spark, docs):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("en", "the house"), ("de", "der hund und die katze"), (None, "xyz"), ("de", None)], "lang string, text string")
    model = lang_id.fit_languages(train)
    rows = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, None), (4, "12 !!"), (5, ""), (6, "qqqq")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lang_id.identify_languages(rows, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[6]["lang_pred"] in ("en", "de") and got[6]["score"] == 0 and got[1]["score"] > 0.9
    assert len(lang_id.identify_languages(docs, model).collect()) == docs.count()
    assert {r["lang_pred"] for r in lang_id.identify_languages(rows, lang_id.fit_languages(train.limit(0))).collect()} == {"und"}


def test_language_counts_match_sets(spark):
    """The filter's counts, corrected for false positives, are near exact look-ups."""
    h = [np.unique(np.concatenate([x for x, _, _ in lang_id.trigrams([t])])) for t in ("the quick brown fox", "der schnelle braune fuchs")]
    model = lang_id.LanguageFilter.of(["a", "b"], [0.5, 0.5], h)
    for x, row, _ in lang_id.trigrams(["the braune fox"]):
        total, got = model.held(x, row, 1)
        assert np.allclose(model.corrected(total, got)[0], [np.isin(x, g).sum() for g in h], atol=0.01) and total[0] == len(x)


def brute_language(train, texts):
    """Languages by sets of character trigrams, none left out."""
    def grams(t):
        t = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        return [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " " or (t[i] != " " and t[i + 2] != " ")]

    names = sorted({n for n, _ in train})
    weight = collections.Counter(n for n, _ in train)
    known = {n: {g for m, t in train if m == n for g in grams(t or "")} for n in names}
    out = []
    for t in texts:
        g = grams(t or "")
        count = {n: sum(x in known[n] for x in g) for n in names}
        best = max(names, key=lambda n: (count[n], weight[n], [-ord(c) for c in n]))
        out.append((best, count[best] / len(g)) if any(c.isalpha() for c in t or "") else ("und", 0.0))
    return out


def test_languages_like_sets(spark):
    """Over a whole table: the filter's predictions and scores are those of exact sets. The model keeps every trigram here."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.filter(lang_id.fold("doc_id", 4) != 2)
    long = "der Hund und die Katze laufen durch den Wald " * 20_000
    more = [(10**6, long), (10**6 + 1, "\U00030001\U00030002"), (10**6 + 2, "\U00010400 x"), (10**6 + 3, "1 2 !"), (10**6 + 4, None), (None, "the dog"), (None, "the dog")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = rows.collect()
    want = brute_language([(r["lang"], r["text"]) for r in train.collect() if r["lang"]], [r["text"] for r in texts])
    model = lang_id.fit_languages(train)
    assert set(model.usual.values()) == {1.0}
    got = lang_id.identify_languages(rows, model).collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in texts]
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g["lang_pred"] != w[0] or abs(g["score"] - w[1]) > 0.02]
    assert not wrong
    assert lang_id.CHUNK_CHARS < len(long) and {r["doc_id"]: r["lang_pred"] for r in got}[10**6 + 1] != "und"


def test_language_ties(spark):
    """A text of as many known trigrams in each language: more training rows, then the smaller name."""
    rows = [("b", "one two"), ("a", "one two"), ("c", "one two"), ("c", "one two")]
    ask = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    for train, want in ((rows, "c"), (rows[:2], "a")):
        model = lang_id.fit_languages(spark.createDataFrame(train, "lang string, text string"))
        assert lang_id.identify_languages(ask, model).first()["lang_pred"] == want


def test_held_out_accuracy(spark):
    rows = lang_id_op(spark).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def lang_id_op(spark):
    return lang_id.op2_lang_id(spark, SF)


def test_quality(spark, docs):
    got = quality.op3_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    right = [(r["predicted"] == r["quality"]) for r in got]
    assert sum(right) / len(right) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    none = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0


def test_word_vectors_are_those_of_all_documents(spark, docs):
    """The distributed sums of many tasks against one loop over positions; labels play no part."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (0, 1, 2, 3, 40, 60, 5, 9)] + [None, "One, two; one!"] * 3
    index, sums = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        for bucket, _, _, _ in quality.tokens(pa.array([t or ""])):
            for i, b in enumerate(bucket):
                for j in range(max(0, i - quality.WINDOW), min(len(bucket), i + quality.WINDOW + 1)):
                    if j != i:
                        sums[b] += index[bucket[j]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(40)
    assert np.allclose(quality.word_vectors(df), quality.normalised(sums), atol=1e-6)
    assert quality.word_vectors(docs.limit(0)).shape == (quality.BUCKETS, quality.DIM)


def test_quality_sample_has_one_text_an_id(spark):
    """Repeated ids with other texts, in any order of rows, give the same model; null ids and labels are left out."""
    rows = [(i, f"good words number {i} and more of them") for i in range(40)] + [(i, "bad " * i) for i in range(40)] + [(None, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 2)] + [(i, None) for i in range(20)] + [(None, 1)], "doc_id long, quality int")
    a, b = (quality.fit_quality(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 3), (rows[::-1], 7)))
    assert np.array_equal(a.vectors, b.vectors) and np.allclose(a.w1, b.w1) and a.temperature == b.temperature


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[100:160] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [math.nan] + [1.0] * 23, 0), (2060, [None] + [1.0] * 23, 0), (2080, [math.inf] * 24, 0), rows[7], (2100, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, index_block=700).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    x = x.astype(float)
    for q in range(0, 1500, 20):
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hit += len(set(best) & {v for _, v, _ in found})
        total += 20
    assert hit / total > 0.9
    assert got[40] and [v for _, v, _ in sorted(got[40])] == list(range(100, 120))
    assert not {2000, 2020, 2040, 2060, 2080} & set(got) and got.get(2100, []) == []
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n,group", [(2000, 1), (32768, 1), (32768, 200), (32768, 8192)])
def test_forest_recall_and_share(n, group):
    """Recall against brute force and the part of the vectors that is read, without clusters and with clusters of `group`."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    if group > 1:
        x = rng.standard_normal((n // group + 1, 64))[np.arange(n) // group] + 0.3 * x
    share = ann.fitted_share(x[rng.permutation(n)[: ann.SAMPLE]], 20, 0.93, ann.TREES)
    recall, read = ann.measured(x, ann.PrefixForest(x), np.arange(0, n, max(20, n // 300)), 20, share)
    print(f"{n} vectors, clusters of {group}: share {share}, recall {recall:.3f}, read {read:.3f}")
    assert recall >= 0.9 and read < (0.75 if n == 2000 else 0.5)


def test_forest_ranges_are_prefixes():
    """The ascent stops at the longest common prefix with enough strings in all trees, and the last level's trees join in turn."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    forest = ann.PrefixForest(x, trees=5)
    flat = np.concatenate([x, np.zeros((400, 1))], axis=1).astype(np.float32)
    longer = np.concatenate([x, np.sqrt(np.linalg.norm(x, axis=1).max() ** 2 - np.linalg.norm(x, axis=1) ** 2)[:, None]], axis=1).astype(np.float32)
    index, ask = ([forest.strings(v, *p) for p in forest.planes] for v in (longer, flat))
    depths = [0, *range(forest.digit, ann.BITS + 1)]
    for i, got in zip(range(10), forest.candidates(x[:10], 30, 0.0), strict=True):
        hits = {d: [np.flatnonzero(s >> np.uint64(64 - d) == q[i] >> np.uint64(64 - d)) if d else np.arange(400) for s, q in zip(index, ask, strict=True)] for d in depths}
        depth = max(d for d in depths if sum(map(len, hits[d])) >= 30)
        want, inner = list(hits[next(d for d in [*depths, 99] if d > depth)]) if depth < ann.BITS else [[]] * 5, hits[depth]
        for t in range(5):
            if sum(map(len, want)) >= 30:
                break
            want[t] = inner[t]
        assert set(got) == set(np.concatenate(want).astype(int))


def brute_losses(rows, target):
    """(words, target loss, background loss) of each text, by two interpolated bigram models in plain Python."""
    ways = [[*w, "</s>"] if (w := words(t)) else [] for t in rows]
    models = [(collections.Counter(), collections.Counter(), collections.Counter()) for _ in range(2)]
    for w, t in zip(ways, target, strict=True):
        for m in models[: 1 + t]:
            m[0].update(w)
            m[1].update(zip(["<s>", *w[:-1]], w, strict=False))
            m[2].update(["<s>", *w[:-1]] if w else [])
    v = len({x for w in ways for x in w[:-1]}) + 1
    n_all, n_ours = (sum(m[0].values()) for m in models)
    out = []
    for w, t in zip(ways, target, strict=True):
        prev = ["<s>", *w[:-1]]
        own = collections.Counter(w), collections.Counter(zip(prev, w, strict=False)), collections.Counter(prev)
        loss = []
        for m, mine, scale in ((models[1], t, 1.0), (models[0], True, n_ours / n_all if n_ours else 1.0)):
            c = lambda i, k: scale * (m[i][k] - mine * own[i][k])  # noqa: B023, E731
            n, total = len(w), scale * (sum(m[0].values()) - mine * len(w))
            uni = lambda x: (c(0, x) + lm_score.ADD) / (total + lm_score.ADD * v)  # noqa: B023, E731
            p = [(c(1, g) + lm_score.MU * uni(g[1])) / (c(2, g[0]) + lm_score.MU) for g in zip(prev, w, strict=False)]  # noqa: B023
            loss.append(-sum(map(math.log, p)) / n if n else 0.0)
        out.append((max(0, len(w) - 1), *loss))
    return out


@pytest.mark.parametrize("name", ["s1", "none"])
def test_cross_entropy(docs, name):
    rows = docs.collect()
    want = brute_losses([r["text"] for r in rows], [r["source"] == name for r in rows])
    key = lambda r: -1 if r["doc_id"] is None else r["doc_id"]
    got = [(key(r), r["n_tokens"], r["loss_target"], r["loss_background"]) for r in lm_score.cross_entropy_difference(docs.repartition(3), F.col("source") == name).collect()]
    want = [(key(r), *w) for r, w in zip(rows, want, strict=True)]
    assert np.allclose(np.array(sorted(got), float), np.array(sorted(want), float), rtol=1e-10, atol=1e-10)
    assert lm_score.cross_entropy_difference(docs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_like_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda names, found: sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_probabilities_add_up():
    """Both models share one vocabulary: over all words and the end, P(w | p) is 1."""
    texts = ["a b a c", "b b", "c a b d"]
    v = ["a", "b", "c", "d", "</s>"]
    add, mu, n = lm_score.ADD, lm_score.MU, 13
    flat = [w for t in texts for w in [*t.split(), "</s>"]]
    pairs = collections.Counter(g for t in texts for g in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True))
    for p in ["<s>", "a", "b", "c", "d"]:
        of_p = len(texts) if p == "<s>" else flat.count(p)
        assert sum((pairs[p, w] + mu * (flat.count(w) + add) / (n + add * len(v))) / (of_p + mu) for w in v) == pytest.approx(1)


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1.001 for s in names)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_contaminated(spark):
    items = spark.createDataFrame([(1, "If Alice has 12 apples and gives 5 apples to Bob how many kg are left for Alice to eat today"), (2, "short item here"), (3, None), (4, ""), (5, "plain words that stand in one single row and nothing else at all in it")], "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(50))
    texts = [
        filler + " if Alice has 12 apples and gives 5 apples to Bob how many kg are left for Alice to eat today " + filler,
        "Well: if Carol has 90 apples and gives 7 apples to Dave how many kg are left for Carol to eat today",
        "Well: if Carol has 90 apples and gives 7 apples to Dave how many kg are left for Dave to eat today",
        filler, None, "", "a short item here too", "plain words that stand in one", filler * 2000,
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1)], "doc_id long, text string, h string, item_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    assert {(0, 1), (1, 1), (6, 2)} <= set(got) and not {d for d, _ in got} & {3, 4, 5, 7, 8}
    assert got[0, 1]["slots_changed"] == 0 and got[1, 1]["slots_changed"] > 0
    assert (2, 1) not in got
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_contaminated_with_conflicting_slots(spark):
    items = ["there are 3 boxes on the shelf with 3 apples each so how many apples are there on the shelf now", "a train takes 12 hours to the sea and another one 5 hours so how long do both take", "we know that Alice went to the market with many friends and after lunch some of them saw that Alice had lost the red hat of the day before"]
    texts = [items[0].replace("3 boxes", "4 boxes").replace("3 apples", "6 apples"), items[1].replace("12", "8").replace("5", "8"), items[2][::-1].replace("ecilA", "lraC", 1)[::-1]]
    df = lambda xs, c: spark.createDataFrame(list(enumerate(xs)), f"{c} long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(df(texts, "doc_id"), df(items, "item_id")).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2)}
    assert [got[i, i]["coverage"] == 1 for i in range(3)] == [True, True, False]
    assert [got[i, i]["slots_changed"] for i in range(3)] == [1, 2, 1]


def test_contaminated_in_other_case_and_place(spark):
    items = spark.createDataFrame([(1, "What is the capital of France"), (2, "Alice Smith"), (3, "so why did the people of London and Paris ask for more trains to Rome than ever before")], "item_id long, text string")
    texts = ["1) What is the capital of France", "(What is the capital of France)", "see What is the capital of France", "what is the capital of france", "see What is the capital of Spain", "SO WHY DID THE PEOPLE OF LONDON AND PARIS ASK FOR MORE TRAINS TO ROME THAN EVER BEFORE", "we met Bob Jones and Alice Jones"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 3, 1)]


def brute_template(text):
    """Words as (template, word): N, U and M stand for numbers, units and names."""
    raw, out, end = (text or "").encode(), [], 0
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw):
        w = m[0]
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        opens = not out or re.search(rb'[.!?:;\n\r"]', raw[end : m.start()])
        if re.search(rb"[0-9]", w):
            kind = b"<N>"
        elif out and out[-1][0] == b"<N>" and low.decode("utf-8", "replace") in decontaminate.UNITS:
            kind = b"<U>"
        else:
            kind = b"<M>" if re.match(rb"[A-Z]", w) and re.search(rb"[a-z]", w) and not opens else low
        out.append((kind, low))
        end = m.end()
    return out


def brute_windows(words, k):
    """(place, key, slots): the template reading, and the case-blind one where it differs."""
    for i in range(len(words) - k + 1):
        part = words[i : i + k]
        blind = [(w if t == b"<M>" else t, w) for t, w in part]
        for reading in [part] + [blind] * (blind != part):
            slots = [(i + j if t == b"<M>" else -1, w) for j, (t, w) in enumerate(reading) if t in (b"<N>", b"<U>", b"<M>")]
            yield i, tuple(t for t, _ in reading), slots


def brute_contaminated(docs, items, window=8, coverage=0.5):
    out = {}
    for item, text in items:
        words = brute_template(text)
        if not words:
            continue
        k = min(window, len(words))
        n, index = len(words) - k + 1, collections.defaultdict(list)
        for i, key, slots in brute_windows(words, k):
            index[key].append((i, slots, False))
        if words[0][0] != b"<N>" and any(t not in (b"<N>", b"<U>", b"<M>") for t, _ in words[1:k]):
            for i, key, slots in brute_windows([(b"<M>", words[0][1]), *words[1:k]], k):
                if key[0] == b"<M>":
                    index[key].append((i, slots, True))
        for doc, body in docs:
            ways = collections.defaultdict(list)
            for at, key, slots in brute_windows(brute_template(body), k):
                for i, own, fixed in index.get(key, ()):
                    if not fixed or slots[0][1] == own[0][1]:
                        ways[at, i].append([(p, x, y) for (p, x), (_, y) in zip(own, slots, strict=True)])
            chains = []
            for at, i in sorted(ways):
                before = [c for c in chains if c[-1] == (at - 1, i - 1)]
                fits = [c for c in chains if 0 < at - c[-1][0] <= i - c[-1][1] + len(words) and c[-1][1] < i]
                drift = lambda c: abs(at - i - c[-1][0] + c[-1][1])  # noqa: B023, E731
                best = before[0] if before else max(fits, key=lambda c: (len(c), -drift(c), c[-1]), default=[])  # noqa: B023
                chains.append([*best, (at, i)])
            for c in chains:
                pairs = {p for m in c for w in ways[m] for p in w}
                names = {x for p, x, _ in pairs if p >= 0}
                votes = lambda x, y: len({p for p, a, b in pairs if p >= 0 and (a, b) == (x, y)})  # noqa: B023, E731
                places = lambda x: len({(p, b) for p, a, b in pairs if p >= 0 and a == x})  # noqa: B023, E731
                stands = {(x, y) for p, x, y in pairs if p >= 0 and (x == y or 2 * votes(x, y) > places(x))}
                clear = names <= {x for x, _ in stands}
                good = lambda p: p[0] < 0 or p[1] == p[2] or (clear and p[1:] in stands)  # noqa: B023, E731
                held = sum(any(all(map(good, w)) for w in ways[m]) for m in c)
                rank = (held / n, -len({x for _, x, y in pairs if x != y}), held)
                if held and held >= coverage * n and rank > out.get((doc, item), (0,)):
                    out[doc, item] = rank
    return {k: (held, share, -changed) for k, (share, changed, held) in out.items()}


def found_items(docs, items):
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["coverage"], r["slots_changed"]) for r in decontaminate.contaminated(docs, items).collect()}


def test_contaminated_like_brute_force(spark):
    """A whole table, and documents made of items with other slots, inserted, dropped and repeated words."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rng = np.random.default_rng(8)
    questions = [r["text"] for r in items.collect()][:12] + ["go to Rome and go to Rome and go to Rome with Ann and 3 kg", "while the old train runs from Paris to Rome the late bus goes back again from Rome to Paris every single day"]
    made, names = [], ["Kyiv", "Lima", "Oslo", "Rome", "12", "7", "kg"]
    for n in range(120):
        words = questions[rng.integers(len(questions))].split()
        for _ in range(rng.integers(0, 8)):
            i = int(rng.integers(0, len(words)))
            what = rng.integers(0, 4)
            words[i : i + 1] = [[words[i], "put", "in"], [], [words[i]] * 2, [names[rng.integers(len(names))]]][what]
        made.append((10**6 + n, "So " + " ".join(words) + (" And " + " ".join(words[:20]) if n % 3 == 0 else "")))
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    asked = items.select("item_id", "text").union(spark.createDataFrame([(1000 + i, q) for i, q in enumerate(questions[12:])], "item_id long, text string"))
    want = brute_contaminated([tuple(r) for r in rows.collect()], [tuple(r) for r in asked.collect()])
    assert found_items(rows, asked) == want and len(want) > 40


def test_slots_are_checked_over_the_whole_passage(spark):
    item = "while the old train runs from Paris to Rome the late bus goes back again from Rome to Paris every single day"
    df = lambda xs, c: spark.createDataFrame(xs, f"{c} long, text string")
    half = "So while the old train runs from {} to {} the late bus goes {} back again from {} to {} every single day"
    texts = [half.format("Kyiv", "Oslo", put, "Oslo" if same else "Lima", "Kyiv" if same else "Bern") for put in ("", "one two three four five") for same in (True, False)]
    got = found_items(df(list(enumerate(texts)), "doc_id"), df([(1, item)], "item_id"))
    assert sorted(d for d, _ in got) == [0, 2] and got[0, 1][1] == 1.0 and got[2, 1][1] >= 0.5


def test_contaminated_with_repeated_rows_and_long_texts(spark):
    item = "a question of more than eight plain words that stands in the middle of nothing"
    filler = " ".join(f"filler{i}" for i in range(2000))
    long = (filler + " ") * 150
    rows = [(1, f"so {item}"), (1, "other"), (1, f"so {item}"), (2, long + item + " " + long), (3, long), (None, item), (4, "word " * 300_000), (5, "go " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (1, item), (1, "another item with the same id and eight words or so"), (2, ""), (None, item), (3, "go " * 40)], "item_id long, text string")
    got = found_items(docs, items)
    assert set(got) == {(1, 1), (2, 1), (5, 3)} and got[1, 1][1] == got[2, 1][1] == got[5, 3][1] == 1.0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 18])
def test_token_counts(spark, block):
    texts = ["hello world", "", None, "<|endoftext|> is text here", "x", "naïve 中文", "y " * 40]
    docs = spark.createDataFrame([(i * 10**15 - 3, t) for i, t in enumerate(texts)] + [(None, "a b"), (-3, "twice")], "doc_id long, text string").coalesce(2)
    encoder = token_counts.load_encoder(token_counts.TOKENIZERS)
    want = sorted((repr(r["doc_id"]), len(encoder.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    got = sorted((repr(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(docs, block_ids=block, file_bytes=60).collect())
    assert got == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_encoder_on_runs_of_white_space():
    """Cut at runs of two and more, the ids are those of the uncut text; runs of millions do not end the worker."""
    encoder = token_counts.load_encoder(token_counts.TOKENIZERS)
    rng = np.random.default_rng(4)
    signs = [" ", " ", "\n", "\t", "\u3000", "\x85", "\x1c", "a", "B", "7", "!", "'s", "é"]
    for _ in range(500):
        text = "".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(0, 40)))
        assert token_counts.encoded(encoder, text, 2) == encoder.encode_ordinary(text), repr(text)
    for sign in (" ", "\n", "\r\n", "a", "!"):
        run = sign * 3000
        for text in (run, "x" + run, run + "y", "x" + run + " y"):
            assert token_counts.encoded(encoder, text, 1000) == encoder.encode_ordinary(text)


def test_token_counts_of_very_long_texts(spark):
    n = 3_000_000
    docs = spark.createDataFrame([(1, "a" + " " * n + "b"), (2, "\n" * n), (3, "word " * 300_000), (4, "z" * 1_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, file_bytes=1 << 20).collect()}
    assert got[1] == n + 1 and got[2] == n / 2 and got[3] == 300_001 and set(got) == {1, 2, 3, 4}


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"][0].split()
    texts = ["Released under the MIT License. mit license", "GNU General\nPublic-License v3", "CC BY-NC; gnu general public", None, "", "x " * 500 + " ".join(mit[:20] + ["extra"] + mit[20:]) + " y" * 300, " ".join(mit[:12]), "mit é license", "word " * 60000]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(0, texts[0], "a"), (None, "apache license", "b")], "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"]) == (2, 3, 5, "mit")
    assert got[1]["base_labels"] == "gpl" and got[2]["base_labels"] == "cc-by" and got[None]["labels"] == "apache"
    assert got[3]["n_words"] == 0 and got[3]["labels"] == "" and got[3]["first_word"] is None and got[4]["score"] == 0
    assert got[5]["labels"] == "mit" and got[5]["base_labels"] == "" and 0.6 <= got[5]["score"] <= 1 and got[5]["spans"][0]["first"] == 500
    assert got[6]["labels"] == "" and got[7]["n_base"] == 0 and got[7]["n_words"] == 3
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for r in licenses.op9_licenses(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r["text"]))
        at = [i for i in range(len(w)) for p in licenses.PHRASES if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))


def test_rolling_hashes(spark):
    """Equal spans have equal hashes, others do not, whatever k is; templates are a table of the caller's."""
    rng = np.random.default_rng(7)
    rows = [[f"w{x}" for x in rng.integers(0, 4, n)] for n in range(0, 30)]
    df = spark.createDataFrame([(r,) for r in rows], "words array<string>")
    for k in (1, 2, 3, 5, 6, 7, 8):
        got = df.select("words", licenses.rolling("words", k).alias("h")).collect()
        seen = {}
        for r in got:
            spans = [tuple(r["words"][i : i + k]) for i in range(len(r["words"]) - k + 1)]
            assert len(r["h"]) == len(spans)
            assert all(seen.setdefault(s, h) == h for s, h in zip(spans, r["h"], strict=True))
        assert len(set(seen.values())) == len(seen)
    own = spark.createDataFrame([("own", "Some text: of seven words, all here!"), ("short", "two words"), (None, "x"), ("none", None)], "label string, text string")
    docs = spark.createDataFrame([(1, "see some TEXT of seven words all here and more, two words"), (2, "mit license")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs, templates=own).collect()}
    assert got == {1: "own", 2: "mit"}


def test_licenses_with_inserted_words(spark):
    """All words of a template are there, with other words between; two broken copies are two spans."""
    table = licenses.template_table(spark, licenses.TEMPLATES)
    names = {r["template"]: r["words"] for r in table.select(licenses.words_of(F.col("text")).alias("words"), "label").withColumn("template", F.concat_ws("-", "label", F.hex(F.xxhash64("words")))).collect()}
    rows, gap = [], [f"gap{i}" for i in range(12)]
    for n, (name, t) in enumerate(names.items()):
        half = len(t) // 2
        broken = t[:half] + gap[:4] + t[half:]
        ways = [broken, t[:half] + gap + t[half:], sum((t[i : i + 10] + ["br"] for i in range(0, len(t), 10)), []), sum((t[i : i + 8] + ["br"] for i in range(0, len(t), 8)), []), broken + gap + broken]
        ways.append(t[half // 2 : half // 2 + 6] + gap + broken)
        rows += [(10 * n + i, " ".join(w), name) for i, w in enumerate(ways)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    for r in licenses.scan_licenses(docs).join(docs.select("doc_id", "name"), "doc_id").collect():
        own = [s for s in r["spans"] if s["template"] == r["name"]]
        assert len(own) == (2 if r["doc_id"] % 10 == 4 else 1), r
        assert all(s["coverage"] > (0.6 if r["doc_id"] % 10 == 3 else 0.85) for s in own), r


def test_warc(spark, tmp_path):
    big, same = "ü" * 600, "<p>same</p>" * 200
    rows = [(1, "http://a/ b\r\nX: y", same), (2, None, same), (9, "u", same), (3, "u", None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (7, "u", big), (9, "u", same), (None, "u", same), (None, "u", "own" * 999), (11, "u", "long " * 4_000_000), (12, "u", "long " * 4_000_000)]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    want = []
    for i, _, h in rows:
        n, last = len((h or "").encode()), {same: 9, "long " * 4_000_000: 12}.get(h)
        want.append((i, n, *(("revisit", last) if last not in (None, i) else ("response", None))))
    assert got == sorted(want, key=repr)
    long = "long " * 4_000_000
    files = f"{tmp_path}/long"
    warc.write_warc(spark.createDataFrame([(k, "u", long if k == 2 else f"<p>{k}</p>" * 40) for k in range(40)], "page_id long, url string, html string").coalesce(1), files, file_bytes=2000)
    heads = [list(warc.members(memoryview(bytes(r["content"])))) for r in flat_files.read_files(spark, files).collect()]
    assert len(heads) > 3 and sum(len(m) > 1 << 24 for h in heads for m in h) == 1
    kinds = collections.Counter(warc.parse(m)[0]["warc-type"] for h in heads for m in h)
    assert kinds == {"response": 40, "metadata": 1}
    assert warc.read_warc(spark, files).count() == 40
    pages = spark.createDataFrame([(1, "u", big)], "page_id long, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w")
    assert warc.read_warc(spark, f"{tmp_path}/w").first()["payload"].decode() == big
    raw = warc.record(1, "u", b"abc", "0" * 40, None)
    for bad in (raw.replace(b"abc", b"abd"), raw[:-5], b"junk"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError, match="inside"):
        list(warc.members(memoryview(warc.member(raw)[:-1])))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == docs.columns and out.count() <= rows.count()
        rows = out
    ids = {r["doc_id"] for r in rows.select("doc_id").collect()}
    kept = {r["doc_id"] for r in near_dup.near_duplicates(rows).filter("kept").collect()}
    assert ids == kept and not {r["doc_id"] for r in decontaminate.contaminated(rows, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}


def test_pipeline_like_brute_force(spark):
    """Every stage on what the last one kept, against scores of the same model on the driver, sets of trigrams, all pairs and
    windows compared one by one, and SQL."""
    import duckdb

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    have = {r["doc_id"]: r for r in rows.collect()}
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    model = quality.fit_quality(rows, labels)
    keep = {i for i, r in have.items() if model.scores(pa.array([r["text"] or ""], pa.large_string()))[0] >= 0.3}
    rows = stage["quality"](spark, rows, SF)
    assert ids(rows) == keep and keep < set(have)

    order = sorted(keep)
    found = brute_language([(have[i]["lang"], have[i]["text"]) for i in order if have[i]["lang"]], [have[i]["text"] for i in order])
    keep = {i for i, (lang, score) in zip(order, found, strict=True) if lang != "und" and score >= 0.2}
    rows = stage["language"](spark, rows, SF)
    assert ids(rows) == keep

    groups = brute_components([(i, have[i]["text"]) for i in keep], 5)
    keep = {i for i, (_, c) in groups.items() if i == c}
    rows = stage["near_dedup"](spark, rows, SF)
    assert ids(rows) == keep and len(keep) < len(groups)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = {d for d, _ in brute_contaminated([(i, have[i]["text"]) for i in keep], items)}
    keep -= held
    rows = stage["decontaminate"](spark, rows, SF)
    assert ids(rows) == keep

    got = stage["mixing"](spark, rows, SF).select("doc_id", "size", "source_size", "target", "taken").collect()
    documents = rows.toPandas()  # noqa: F841
    want = duckdb.sql(mixing.OP6_SQL.replace("FROM documents", "FROM documents")).fetchall()
    assert sorted((r["doc_id"], r["taken"], round(r["target"], 6)) for r in got) == sorted((r[0], r[4], round(r[3], 6)) for r in want)
    assert ids(corpus_pipeline.run(spark, SF)) == keep


def test_pipeline_stages_on_edge_tables(spark):
    """Empty tables, columns with names that operators use themselves, nulls in all columns, very long texts."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "row", "value", "slots", "component_id", "item_id", "h", "m", "size_of"]
    types = ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names)
    long = "the quick brown fox jumps over the lazy dog and runs away from it " * 4000
    rows = [(i, f"{t} {i}" if t else t, "en", "s", 0, *"abcdefgh") for i, t in enumerate([long, "the quick brown fox jumps", None, "", "over the lazy dog"])] + [(None,) * len(names)]
    docs = spark.createDataFrame(rows, types)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        full = stage(spark, docs, SF)
        assert empty.count() == 0 and len(full.collect()) <= len(rows)
        if name != "mixing":
            assert full.columns == empty.columns == names
            assert name == "quality" or any(r["doc_id"] == 0 for r in full.collect())


def test_language_stage_keeps_flat_scripts_on_large_tables(spark):
    """A share of 0.1 or so of a text's trigrams is frequent in its language, the others occur once in the table."""
    rng = np.random.default_rng(9)
    rare = lambda n: "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, n))
    rows = [(i, "".join(f"{rare(36)}天地玄黃宇宙" for _ in range(10)), "zh") for i in range(400)]
    rows += [(1000 + i, "the quick brown fox jumps over the lazy dog " * 20, "en") for i in range(40)]
    rows += [(2000, "".join(chr(c) for c in rng.integers(0x0E01, 0x0E2F, 400)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n in (20, 400):
        part = docs.filter(f"doc_id < {n} or doc_id >= 1000")
        got = {r["doc_id"] for r in corpus_pipeline.language(spark, part, SF).select("doc_id").collect()}
        assert got == {*range(n), *range(1000, 1040)}


def test_pipeline_stages_with_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rows = [(5, a), (5, b), (3, a), (7, b + " more"), (None, c), (None, c), (8, d), (None, d), (9, ""), (9, ""), (9, None), (None, ""), (5, c + " " + d)]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_dedup(spark, docs(rows), SF).collect())
    assert got == sorted([(3, a), (5, b), (0, c), (8, d), (9, ""), (0, ""), (5, c + " " + d)])
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, a), (1, "so " + item), (None, item), (None, b)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.decontaminate(spark, docs(rows), SF).collect())
    assert got == [(0, b), (1, a)]
