"""Operators 2 to 6: language, near copies, language model, URLs, benchmark leaks."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from logvane.llm import components, decontam, jaccard, langid, lm, queries, urls

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0d]+")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


# --- 2: language


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 7, 8, 20):
        code = langid.codewords(n)
        least = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert least >= (1 if n == 2 else code.shape[1] // 4)
        assert all(0 < (code[:, k] > 0).sum() < n for k in range(code.shape[1]))


def test_language_of_every_row(spark):
    rows = [(k, "the cat and the dog ran home", "en") for k in range(20)]
    rows += [(100 + k, "der Hund und die Katze gehen heim", "de") for k in range(20)]
    rows += [(200, "el perro y la gata van a casa", None), (201, None, "en"), (202, "123 --", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ("de", "en")
    asked = [
        (1, "the dog and the cat"), (2, "die Katze und der Hund"), (3, None), (4, ""), (5, "12 3!"),
        (6, "the dog und die Katze " * 3), (7, "der Hund " * 20_000), (None, "the cat"), (1, "the dog and the cat"),
    ]
    told = langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    by_id = {r.doc_id: r for r in told}
    assert len(told) == 9 and all(0 <= r.score <= 1 for r in told)
    assert [by_id[k].lang_pred for k in (1, 2, 3, 4, 5, 7, None)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert by_id[1].score > 0.9 and by_id[3].score == 0


def test_nothing_learned_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(df, model).collect()] == ["und"]
    assert langid.predict(df.limit(0), model).count() == 0


def test_op2_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in documents(spark).collect()}
    rows = queries.QUERIES["op2_language_id"](spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(held) >= 0.95 * len(held)


# --- 3: near copies


def similar(pairs):
    """Class and links of every row, comparing all with all."""
    sets = [frozenset(jaccard.shingles(t).tolist()) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [set() for _ in pairs]
    for a in range(len(pairs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                root[find(a)] = find(b)
                if pairs[a][1] != pairs[b][1]:
                    links[a].add(pairs[b][1])
                    links[b].add(pairs[a][1])
            elif not x and pairs[a] == pairs[b]:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (doc_id, _) in enumerate(pairs):
        least[find(k)].append(doc_id)
    ids = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((p[0], ids[find(k)], len(links[k])) for k, p in enumerate(pairs)), key=repr)


def edited(words, every, random_):
    out = list(words)
    for k in range(random_.randrange(every), len(out), every):
        out[k] = f"new{random_.randrange(10**9)}"
    return " ".join(out)


def near_pairs():
    random_ = random.Random(5)
    base = [f"b{random_.randrange(10**6)}" for _ in range(200)]
    pairs = [(k, edited(base, 190, random_)) for k in range(60)]
    pairs += [(100 + k, " ".join(base)) for k in range(30)]
    pairs += [(200 + k, " ".join(base[:60]) + edited([f"u{k}x{j}" for j in range(150)], 9, random_)) for k in range(80)]
    pairs += [(400, None), (401, ""), (401, ""), (402, "a b"), (403, "a b"), (404, "a b c"), (None, "a b"), (405, " \n")]
    pairs += [(130, "\n".join(base)), (131, "  ".join(base)), (408, "a\tb"), (409, "c d e f g " * 9), (410, "c d e f g " * 10)]
    pairs += [(406, " ".join(f"l{j}" for j in range(20_000))), (407, " ".join(f"l{j}" for j in range(19_800)))]
    return pairs


def test_classes_and_links_against_brute_force(spark, make_docs, monkeypatch):
    pairs = near_pairs()
    found = jaccard.classes(make_docs(pairs)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, found), key=repr) == similar(pairs)


def test_large_buckets_are_split_and_cut_into_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 16)
    monkeypatch.setattr(jaccard, "EXACT_LIMIT", 8)
    pairs = near_pairs()
    found = jaccard.classes(make_docs(pairs)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, found), key=repr) == similar(pairs)


def test_keep_one_of_each_class(spark, make_docs):
    pairs = near_pairs()
    docs = make_docs(pairs)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    classes = {r[:2] for r in similar(pairs) if r[1] is not None}
    assert len(rows) == len({c for _, c in classes})
    assert {c for _, c in classes} == {i for i, _ in rows}
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_op3_whole_table(spark):
    pairs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    rows = queries.QUERIES["op3_jaccard_join"](spark, SF).collect()
    assert sorted(map(tuple, rows), key=repr) == similar(pairs)


@pytest.mark.parametrize(
    "edges",
    [
        [], [(1, 1)], [(1, 2), (2, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 90)],
        [(None, 1), (2, 3)], [(k, k % 7) for k in range(100)],
    ],
)
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    found = sorted(map(tuple, components.components(df).collect()))
    assert found == sorted((x, find(x)) for x in root)


# --- 4: language model


def lm_tokens(text):
    lower = {k: k + 32 for k in range(65, 91)}
    return [w.translate(lower) for w in SPACE.findall(text or "")] + [None]


def check_base(rows, texts):
    counts = collections.Counter()
    for doc_id, text in texts:
        if crc(doc_id) % 10:
            counts.update(lm_tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    whole = math.log10(total + 0.1 * (distinct + 1))
    expected = collections.Counter()
    for doc_id, text in texts:
        found = lm_tokens(text)
        base = sum(math.log10(counts[w] + 0.1) - whole for w in found)
        known = sum(counts[w] > 0 for w in found)
        expected[(doc_id, crc(doc_id) % 10 == 0, len(found), known, total, round(base, 6))] += 1
    got = collections.Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows
    )
    assert got == expected
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def scored(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm.fit(df.where(~lm.held_out(df.doc_id)))
    out = lm.score(df, model)
    return out.select("doc_id", lm.held_out(out.doc_id).alias("held_out"), *out.columns[1:]).collect()


LM_TEXTS = [
    (1, "The the THE cat"), (2, None), (3, ""), (4, "the cat sat É é"), (4, "the cat sat É é"),
    (None, "the end"), (5, "w " * 5000), (18, "rare words only here"), (19, "the cat sat"), (6, " \n"),
    *((k, "the cat sat on the mat and the dog ran") for k in range(20, 60)),
]


def test_base_scores_with_and_without_frequent_words(spark, monkeypatch):
    check_base(scored(spark, LM_TEXTS), LM_TEXTS)
    monkeypatch.setattr(lm, "FREQUENT", 3)
    check_base(scored(spark, LM_TEXTS), LM_TEXTS)


def test_pairs_seen_once_count(spark):
    random_ = random.Random(8)
    texts = [(k, " ".join(f"w{random_.randrange(150)}" for _ in range(9))) for k in range(120)]
    words, both = collections.Counter(), collections.Counter()
    for doc_id, text in texts:
        if crc(doc_id) % 10:
            found = lm_tokens(text)
            words.update(found)
            both.update(zip([None, *found], found))
    total, distinct = sum(words.values()), len(words)

    def stored(n):
        return lm.BASE ** math.floor(math.log(n) / math.log(lm.BASE) + 1e-9) if n else 0

    def log_p(v, w):
        p = (stored(words[w]) + 0.1) / (total + 0.1 * (distinct + 1))
        return math.log10((stored(both[v, w]) + lm.MU * p) / (stored(words[v]) + lm.MU))

    assert sum(n == 1 for n in both.values()) > 0.9 * len(both)
    expected = {k: sum(log_p(v, w) for v, w in zip([None, *lm_tokens(t)], lm_tokens(t))) for k, t in texts}
    assert {r.doc_id: r.score for r in scored(spark, texts)} == pytest.approx(expected, abs=1e-6)


def test_segments_add_up_to_the_whole(spark, monkeypatch):
    one = sorted((repr(r.doc_id), r.n_tokens, round(r.score, 9)) for r in scored(spark, LM_TEXTS))
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 16)
    many = sorted((repr(r.doc_id), r.n_tokens, round(r.score, 9)) for r in scored(spark, LM_TEXTS))
    same = sum(a == b for a, b in zip(one, many, strict=True))
    assert same >= 0.9 * len(one)  # other bits give other errors of the filter


def test_filter_finds_every_ngram_at_its_level():
    import pyarrow as pa

    random_ = np.random.default_rng(3)
    grams = random_.integers(0, 2**63, 5000, dtype=np.uint64)
    level = random_.integers(1, 9, 5000)
    segment = lm.Segment(0, 1, 1)
    table = pa.table({"gram": grams.view(np.int64), "level": level, "segment": [0] * 5000, "block": [0] * 5000})
    built = lm._build_block(table)
    segment.bits[:] = np.frombuffer(built.column("bits")[0].as_py(), np.uint8)
    found = segment.levels(grams)
    assert (found >= level).all() and (found == level).mean() > 0.95
    assert (segment.levels(random_.integers(0, 2**63, 5000, dtype=np.uint64)) == 0).mean() > 0.95


def test_words_of_all_lengths_are_told_apart():
    base = "abcdefgh" * 40
    odd = [base[:k] for k in range(1, 200)] + [base[:k] + "\0" for k in range(0, 140)] + ["é" * 40, "a\u00a0b"]
    odd += [base[:k] + "x" + base[k:100] for k in range(0, 99)]
    texts = [None, "", " \t", *odd, "\x0b".join(odd), "\r\n ".join(odd) + " ", "".join(odd).upper()]
    hashes, lengths = lm.tokens(texts)
    expected = [w for text in texts for w in lm_tokens(text)]
    assert lengths.tolist() == [len(lm_tokens(text)) for text in texts]
    met = set(zip(expected, hashes.tolist(), strict=True))
    assert len(met) == len(set(expected)) == len(set(hashes.tolist())) and not (hashes & np.uint64(1)).any()


def test_counts_travel_in_packed_columns(spark, monkeypatch):
    monkeypatch.setattr(lm, "SET_BYTES", 64)
    df = spark.createDataFrame(LM_TEXTS, "doc_id long, text string").repartition(3)
    counted = lm.count_ngrams(df)
    # no aggregation, so no shuffled row, per n-gram
    assert "HashAggregate" not in counted._jdf.queryExecution().executedPlan().toString()
    words, both = collections.Counter(), collections.Counter()
    for _, text in LM_TEXTS:
        found = lm_tokens(text)
        words.update(found)
        both.update(zip([None, *found], found))
    rows = counted.collect()
    assert len({r.gram for r in rows}) == len(rows)
    assert sorted(r.n for r in rows if r.gram % 2 == 0) == sorted(words.values())
    assert sorted(r.n for r in rows if r.gram % 2) == sorted(both.values())


def test_nothing_to_learn_or_to_score(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm.fit(df.limit(0))
    rows = lm.score(df, model).collect()
    assert {(r.doc_id, r.n_known, r.train_tokens) for r in rows} == {(1, 0, 0), (2, 0, 0)}
    assert lm.score(df.limit(0), model).count() == 0


def test_op4_whole_table_and_gain_over_single_words(spark):
    texts = [(r.doc_id, r.text) for r in documents(spark).collect()]
    rows = queries.QUERIES["op4_lm_bloom"](spark, SF).collect()
    check_base(rows, texts)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# --- 5: urls


def test_rules_and_aliases(spark):
    rows = [
        (1, "http://a.net/x", '<link rel="canonical" href="https://b.com/de/1">'),
        (2, "https://B.com/de/1", None),
        (3, "http://c.net/p", "<meta http-equiv=refresh content='0;url=http://a.net/x#z'>"),
        (4, "https://d.org/es/", ""), (5, None, "x"), (6, "nourl", ""),
        (7, "http://q.net/y", "<LINK href='/z' rel='canonical'>"), (8, "https://q.net/z", ""),
        (9, "http://www.example.org/en/12?x", ""),
        (10, "http://e.net/k", "<link rel=canonical href=\"http://t.org/\">"),
        (11, "http://f.net/", '<link rel=canonical href="http://e.net/k"><link rel="canonical" href="http://g.com/de/">'),
        (12, "http://org/", ""), (13, "http://xorg/", ""), (14, "http://k.com/fr/", ""), (15, "http://k.com", ""),
        (2, "https://B.com/de/1", None), (None, "://h.org/?q", None), (16, "http://a.net/x?page=2", ""),
        (17, "http://gone.net/", "<link rel='canonical' href='http://www.example.org/es/9'>"),
        (18, "http://x.org/", "<link rel='canonical' href='http://y.com/de/2'>"),
    ]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect())
    assert got == collections.Counter(
        [
            (1, "a.net", "/x", None, "block"), (2, "b.com", "/de/1", "com/de/", "block"),
            (2, "b.com", "/de/1", "com/de/", "block"), (3, "c.net", "/p", None, "block"),
            (4, "d.org", "/es/", "org/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
            (7, "q.net", "/y", None, "allow"), (8, "q.net", "/z", None, "allow"),
            (9, "www.example.org", "/en/12", "example.org/en/1", "block"),
            (10, "e.net", "/k", None, "allow"), (11, "f.net", "/", None, "allow"),
            (12, "org", "/", "org/", "allow"), (13, "xorg", "/", None, "allow"),
            (14, "k.com", "/fr/", "com/fr/", "allow"), (15, "k.com", "", None, "allow"),
            (None, "h.org", "/", "org/", "allow"), (16, "a.net", "/x", None, "allow"),
            (17, "gone.net", "/", None, "block"), (18, "x.org", "/", "org/", "allow"),
        ]
    )


def test_given_redirects_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", ""), (2, "http://b.net/", "")], "page_id long, url string, html string")
    more = spark.createDataFrame([("http://a.net/", "http://z.com/de/"), (None, "http://b.net/")], "a string, b string")
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages, redirects=more).collect()}
    assert verdicts == {1: "block", 2: "allow"}
    assert urls.judge(pages.limit(0)).count() == 0


# --- 6: benchmark leaks


def plain_alignment(item, words):
    """Smith-Waterman cell by cell."""
    best, above = 0, [0] * (len(words) + 1)
    for w in item:
        row = [0]
        for j, v in enumerate(words):
            row.append(max(0, above[j] + (2 if v == w else -1), above[j + 1] - 1, row[j] - 1))
            best = max(best, row[-1])
        above = row
    return best / (2 * len(item))


def test_alignment_against_cell_by_cell():
    random_ = np.random.default_rng(4)
    for _ in range(60):
        item = random_.integers(0, 6, random_.integers(1, 15)).astype(np.uint64)
        words = random_.integers(0, 6, random_.integers(1, 40)).astype(np.uint64)
        score, start, end = decontam.align(item, words)
        assert score == pytest.approx(plain_alignment(item.tolist(), words.tolist()))
        assert plain_alignment(item.tolist(), words[start:end].tolist()) == pytest.approx(score)


ITEM = "What Is the boiling point of water at the top of the highest mountain, in degrees Celsius?"
ITEMS = [(1, ITEM), (2, "capital city of the country with the longest coast on earth"), (3, "two words"), (4, None), (5, ""), (None, ITEM), (6, ITEM)]
FILL = " ".join(f"f{k}" for k in range(60))
LEAKS = [
    (1, f"{FILL} {ITEM} {FILL}"), (2, f"{FILL} what is the boiling point of WATER near the top of a high mountain in degrees celsius {FILL}"),
    (3, FILL), (4, None), (5, ""), (6, "the capital city of the country with longest coast on earth"), (6, "the capital city of the country with longest coast on earth"),
    (7, "the of the in the " * 50), (8, "two words"), (None, ITEM), (9, f"{FILL} " * 300 + ITEM), (10, "what is the point of the capital city"),
]


def test_exact_and_edited_leaks(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.leaks(make_docs(LEAKS), items).collect()
    got = collections.Counter((r.doc_id, r.item_id) for r in rows)
    whole = [(i, k) for i in (1, 2, None, 9) for k in (1, 6)]
    assert got == collections.Counter([*whole, (6, 2), (6, 2)])
    assert all(0.4 <= r.score <= 1 for r in rows)
    exact = [r for r in rows if r.doc_id == 1]
    assert all((r.score, r.start, r.end) == (1.0, 60, 77) for r in exact)


def test_clean_documents_stay(spark, make_docs):
    items, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), make_docs(LEAKS)
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 8, 10]
    assert decontam.clean(docs, items.limit(0)).count() == len(LEAKS)
    assert decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), items).count() == 0


def test_benchmark_in_blocks(spark, make_docs, monkeypatch):
    items, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), make_docs(LEAKS)
    whole = sorted(map(tuple, decontam.leaks(docs, items).collect()), key=repr)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 12)
    assert sorted(map(tuple, decontam.leaks(docs, items).collect()), key=repr) == whole


def pairs_by_brute_force(docs, items):
    """Documents and items whose plain alignment reaches the score, and that score."""
    score = {
        (i, k): plain_alignment(decontam.word_hashes(item).tolist(), decontam.word_hashes(text).tolist())
        for i, text in docs
        for k, item in items
        if len(decontam.word_hashes(item)) >= 3
    }
    return {pair: x for pair, x in score.items() if x >= decontam.SCORE}


@pytest.mark.parametrize("exact_beside", [False, True])
def test_edited_leaks_against_brute_force(spark, make_docs, exact_beside):
    random_ = random.Random(6)
    common = [f"c{k}" for k in range(40)]
    items = [(k, " ".join(random_.choices([*common, *(f"r{k}_{j}" for j in range(40))], k=20 + k))) for k in range(12)]
    docs = [(1000 + k, item) for k, item in items] if exact_beside else []
    for every in range(2, 7):
        for k, item in items:
            for at in (0, every - 1):
                words = item.split()
                for j in range(at, len(words), every):
                    words[j] = f"x{j}"
                around = random_.choices(common, k=60)
                docs.append((len(docs), " ".join([*around[:30], *words, *around[30:]])))
    for k, item in items:
        apart = " ".join(f"{w} y{j}" for j, w in enumerate(item.split()))
        fewer = " ".join(w for j, w in enumerate(item.split()) if j % 3)
        docs += [(5000 + k, apart), (6000 + k, fewer)]
    rows = decontam.leaks(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    truth = pairs_by_brute_force(docs, items)
    assert len(truth) > 100
    assert {(r.doc_id, r.item_id): r.score for r in rows} == pytest.approx(truth)


def test_seeds_lose_no_alignment():
    random_ = random.Random(7)
    found = 0
    for _ in range(300):
        few = random_.randint(3, 30)
        items = [(k, " ".join(f"w{random_.randrange(few)}" for _ in range(random_.randint(1, 14)))) for k in range(4)]
        docs = [(k, " ".join(f"w{random_.randrange(few)}" for _ in range(random_.randint(0, 50)))) for k in range(4)]
        block = decontam.Items(items, decontam.SCORE)
        got = {(i, m[0]): m[1] for i, text in docs for m in decontam._best_by_item(block, text, decontam.SCORE)}
        assert got == pytest.approx(pairs_by_brute_force(docs, items))
        found += len(got)
    assert found > 500


def test_op6_finds_every_exact_passage(spark):
    def plain(text):
        return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "

    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: plain(r.text) for r in documents(spark).collect()}
    truth = {(i, k) for i, text in docs.items() for k, item in items.items() if item in text}
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, SF).collect()}
    assert truth and truth <= found
