"""The operators on documents against plain versions, and their rules for odd input."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.llm import langid, mixing, packing, partenum, pii, quality, toxicity
from pairloom.llm.common import tokenizer_path
from pairloom.llm.hilbert import hilbert_index, hilbert_shards
from pairloom.llm.textblocks import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = [(None, "null id", "en", "a", 7), (900, None, "en", "a", None), (901, "", None, None, 0), (902, " \t\n", "en", "b", 3), (903, "123 ... !!", "en", "b", 10), (904, "word " * 30_000, "en", "c", 150_000), (905, "same row here twice over", "en", "c", 3), (905, "same row here twice over", "en", "c", 3)]


def made(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 8, 40, 90])))
        out.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 5 == 0:
            words = text.split()
            words[len(words) // 2] = "changed"
            out.append((1000 + i, " ".join(words), "en", f"s{i % 3}", len(text)))
        if i % 7 == 0:
            out.append((2000 + i, text, None, None, len(text)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(60) + ODD, SCHEMA).withColumns({"size": F.lit("x"), "node": F.lit(1), "score": F.lit(0.5), "rank": F.lit(2), "shard": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_shingle_counts_match_plain_sets():
    for t in ["", "a", "A b\x0bC d", "a b c d e", "a b c d e a b c d e f", "x " * 50, "é É A"]:
        assert len(shingles([t.encode()])[0]) == len(shingle_set(t))


def components(rows):
    sets = [shingle_set(r.text) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted(((r.doc_id or -1, len(sets[i]), least.get(find(i), -1)) for i, r in enumerate(rows)), key=str)


def test_jaccard_components_match_brute_force(docs):
    got = sorted(((r.doc_id or -1 if r.doc_id != 0 else -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in partenum.jaccard_components(docs).collect()), key=str)
    assert got == components(docs.collect())


def test_signatures_meet_for_all_linked_sets():
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(600):
        n = int(rng.integers(3, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        edits = int(rng.integers(0, max(2, int(0.3 * n))))
        b = np.unique(np.concatenate([a[edits // 2 :], rng.integers(0, 2**63, int(rng.integers(0, edits + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 75 * (len(a) + len(b) - common) and not len(a) == common == len(b):
            frequent = rng.permutation(a)[: n // 2]
            for f in (None, (np.sort(frequent), rng.permutation(len(frequent)))):
                small, large = sorted((a, b), key=len)
                marked = {int(x) for s, m, _ in partenum.signatures(small, 75, f) for x in s[:m]}
                assert marked & {int(x) for s, _, _ in partenum.signatures(large, 75, f) for x in s}
            met += 1
    assert met > 200


def test_sketches_never_differ_in_more_bits_than_sets_in_features():
    rng = np.random.default_rng(1)
    for n in (5, 100, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 4).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert 0 < partenum.bits_apart(partenum.sketch(a), partenum.sketch(b)) <= apart
        if n == 5000:
            assert 0.7 * apart < partenum.bits_apart(partenum.wide_sketch(a), partenum.wide_sketch(b)) <= apart
            assert len(partenum.wide_sketch(a[:1500])) < len(partenum.wide_sketch(a))
            assert partenum.bits_apart(partenum.wide_sketch(a[:1500]), partenum.wide_sketch(a)) <= len(a) - 1500


def test_a_large_group_near_the_threshold_matches_brute_force(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    # a passage that makes up most of many texts that are not near each other
    rows += [(1000 + i, " ".join(base[:60] + [f"p{i}x{k}" for k in range(rng.randint(8, 60))])) for i in range(200)]
    long = [f"l{i}" for i in range(900)]
    rows += [(2000 + i, " ".join(long[: 900 - 40 * i] + [f"q{i}x{k}" for k in range(20 * i)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in partenum.jaccard_components(df).collect()), key=str)
    want = components(df.collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [(g[1], g[2]) for g in got] == [(w[1], w[2] or -1) for w in want]
    assert len({w[2] for w in want}) > 20


def test_leaders_are_copied_only_to_the_parts_that_a_bucket_needs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(2400):
        words = list(base)
        words[rng.randrange(60)] = f"e{i}"
        rows.append((1 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = partenum._met(df, "text", 5, 75, 32).cache()
    lead = met.where(f"u * held < {partenum.FIRST}")
    copies = lead.select(F.sum(F.expr("1 + held div 2048"))).first()[0]
    assert lead.where("held > 100 and held < 2048").count() > 20
    assert partenum._leads(met, 0, partenum.FIRST).count() == copies < 2 * lead.count()
    # of a bucket dealt over many parts no link is lost
    some = df.where("doc_id <= 150")
    monkeypatch.setattr(partenum, "SETS_PER_PART", 10)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.jaccard_components(some).collect())
    assert got == sorted(components(some.collect()))


def test_keep_one(docs, empty):
    kept = partenum.keep_one(docs)
    assert kept.columns == docs.columns and partenum.keep_one(empty).isEmpty()
    comps = {r.doc_id: r for r in partenum.jaccard_components(docs).collect()}
    want = sorted(i for i, r in comps.items() if i is not None and (r.n_shingles == 0 or r.component_id == i))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == want


def test_no_task_of_the_join_needs_a_second_python_worker(docs, monkeypatch):
    plans, store = [], partenum.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(partenum, "stored", noted)
    plans.append(partenum.keep_one(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum("MapInPandas" in p for p in plans) >= 4
    for plan in plans:
        assert "EvalPython" not in plan
        # of a stage's operators none is below an exchange
        assert all(stage.count("MapInPandas") <= 1 for stage in re.split(r"Exchange|Union", plan))


def test_a_bitmap_splits_rows_and_misses_no_member(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BITMAP_BITS", (10, 12))
    rows = spark.range(-500, 500).selectExpr("if(id = 7, null, id) as key", "id as other")
    ids = rows.where("other % 7 = 0").select(F.col("key").alias("doc_id"))
    bitmap = partenum._bitmap(ids)
    on, off = (sorted(r.other for r in partenum._held(rows, bitmap, "key", on=x).collect()) for x in (True, False))
    assert sorted(on + off) == list(range(-500, 500)) and {x for x in range(-500, 500) if x % 7 == 0} <= set(on)
    assert len(on) < 400 and partenum._held(rows, bitmap, "key").columns == rows.columns


def test_hashing_a_block_of_texts_takes_little_memory():
    texts = [" ".join(WORDS[(i * j) % 20] for j in range(400)).encode() for i in range(450)]
    shingles(texts)
    tracemalloc.start()
    found = shingles(texts)
    assert len(found) == 450 and sum(map(len, texts)) > 900_000
    assert tracemalloc.get_traced_memory()[1] < 15e6
    tracemalloc.stop()
    assert all((a == shingles([t])[0]).all() for a, t in zip(found[::50], texts[::50], strict=True))


def test_packing_is_gapless_and_round_trips(docs, empty):
    from tokenizers import Tokenizer

    packed = packing.pack_documents(docs, tokenizer_path(), capacity=256, with_ids=True)
    rows = packed.collect()
    tok = Tokenizer.from_file(tokenizer_path())
    by_doc = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        by_doc.setdefault((r.doc_id, r.piece), r)
    for d in docs.collect():
        ids, k, got = [*tok.encode(d.text or "", add_special_tokens=False).ids, 1], 0, []
        while (d.doc_id, k) in by_doc:
            got += by_doc[d.doc_id, k].ids
            k += 1
        assert got == ids
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.length == len(r.ids) <= 256
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256 and len(ends) <= -(-sum(ends.values()) // 256) + 3
    assert packing.pack_documents(empty, tokenizer_path()).isEmpty()


@pytest.mark.parametrize("text", ["naïve café l'été it's I'LL 12,345.67!!", "日本語 テキスト", "é x\x1cy \x85z", "<|endoftext|> x", "ΑΣ Σ İ ﬁ ² ½ a_b __", "tab\tnl\n\x0b end\x00\x01", " ", "don't.Stop’s"])
def test_word_tokenizer_equals_whole_tokenizer(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordTokenizer(tokenizer_path())(text), "<u4").tolist() == ids


def test_word_tokenizer_equals_whole_tokenizer_on_letters_with_marks():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path())
    marks = [chr(c) for c in range(0x300, 0x370)] + [chr(c) for r in ((0x483, 0x488), (0x591, 0x5BE), (0x64B, 0x660), (0x93C, 0x93D), (0x1AB0, 0x1ABF), (0x1DC0, 0x1E00), (0x20D0, 0x20F1), (0x3099, 0x309B)) for c in range(*r)]
    letters = [chr(c) for r in ((0x41, 0x5B), (0xC0, 0x180), (0x386, 0x3D0), (0x410, 0x430), (0x1E00, 0x2000), (0x2126, 0x212C)) for c in range(*r)]
    rng = random.Random(4)
    for i in range(6000):
        text = "".join(rng.choice(letters) + rng.choice(marks) * rng.randint(0, 2) + rng.choice(["", "", " ", "a", "'s"]) for _ in range(rng.randint(1, 4)))
        if i < 2:
            text = ("\u0389\u0345", "\u2126\u0342")[i]
        assert np.frombuffer(own(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_word_tokenizer_remembers_a_bounded_number_of_words():
    tok, small = packing.WordTokenizer(tokenizer_path()), packing.WordTokenizer(tokenizer_path(), room=10)
    for i in range(0, 120_000, 1000):
        text = " ".join(chr(97 + k % 26) + chr(97 + k // 26 % 26) + chr(97 + k // 676 % 26) + chr(97 + k // 17576) for k in range(i, i + 1000))
        ids = tok(text)
        assert i % 40_000 or ids == small(text)
        assert len(tok.words) <= 51_000 and len(tok.parts) <= 101_000


def test_word_tokenizer_remembers_frequent_parts_and_signs_at_the_end_once(monkeypatch):
    tok = packing.WordTokenizer(tokenizer_path(), room=40)
    asked: list[str] = []
    monkeypatch.setattr(packing, "_packed", lambda ids, f=packing._packed: asked.append("x") or f(ids))
    rare = [chr(97 + k // 26) + chr(97 + k % 26) + "zq" for k in range(500)]
    signs = [".", ",", "!!", ".!!", "%%%", "..."]
    for i, word in enumerate(rare):
        tok(f"often{signs[i % 6]} {word}")
    # each rare word once, the frequent one and its signs only once in all: a memory that is cleared asks for them again
    assert len(asked) == len(rare) + 1 + len(signs)
    assert len(tok.parts) <= 40 and len(tok.older) <= 40


@pytest.mark.parametrize("text", ["a_. b._ c», d”. e.». f.' g's. h!!'s don't. İx. İ, aİ.. ΟΔΟΣa. ΑΣ. x². y½, 1. 2.0. \u00e9. e\u0301. \u4e2d. \u0436, é_ß.. ..a.. 'll. i'll! a\u00a0. b.\u0085c. z.\x00 q\u0301. r.\u0301 s.é ǀ. ª. º, (k) [l]. w\u200b.", "Caf\u00e9?! <b>x</b>. a</w>. </w> x.</w>"])
def test_word_tokenizer_cuts_signs_at_the_end_as_the_whole_tokenizer(text):
    from tokenizers import Tokenizer

    for t in (text, text.upper()):
        assert np.frombuffer(packing.WordTokenizer(tokenizer_path())(t), "<u4").tolist() == Tokenizer.from_file(tokenizer_path()).encode(t, add_special_tokens=False).ids


def test_packing_gives_the_memory_of_each_batch_back(spark, monkeypatch):
    from pairloom.llm import common

    def used():
        return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon")) / 1024

    class Docs:
        def select(self, *columns):
            return self

        def mapInPandas(self, f, schema):
            return f

    kept, done = [], []

    def frames():
        for n in range(3):
            texts = [f"{i} {n} " + "a " * 1500 for i in range(10_000)]
            kept.extend(texts[::500])  # what stays lies among what goes
            yield pd.DataFrame({"doc_id": range(10_000), "text": texts}).head(20)

    trim = common.give_back
    monkeypatch.setattr(common, "give_back", lambda: done.append(trim()))
    before = used()
    assert sum(len(f) for f in packing.cut_pieces(Docs(), tokenizer_path())(frames())) == 60
    assert len(done) == 3 and used() < before + 60


def test_plan_covers_any_histogram():
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 60) for _ in range(rng.randint(1, 30))}
        plan = packing.plan_sequences(counts, 100)
        assert plan.groupby("length")["count"].sum().to_dict() == counts
        load = {}
        for r in plan.itertuples():
            for k in range(r.count):
                load[r.sequence + k // r.per] = load.get(r.sequence + k // r.per, 0) + r.length
        assert max(load.values()) <= 100


def test_mix_meets_targets(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [r.target, 0, r.source_size, 0])
        t[1] += r.taken
        t[3] += r.size
    total = sum(t[3] for t in by.values())
    assert all(t[2] == t[3] for t in by.values()) and abs(sum(t[0] for t in by.values()) - total) < 1e-6
    assert all(t[0] <= 3 * t[2] + 1e-6 for t in by.values())
    for s, (target, taken, _, _) in by.items():
        whole = {r.copies for r in rows if r.source == s and r.size > 0}
        left = [r.size for r in rows if r.source == s and r.size > 0 and r.copies == min(whole)]
        assert abs(target - taken) <= max(left) / 2 + 1e-6, (s, target, taken)
    assert mixing.mix_sources(empty).isEmpty()
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_shards_differ_by_one_row(docs, empty):
    rows = hilbert_shards(docs, 7).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and hilbert_shards(empty, 7).isEmpty()


def test_equal_texts_share_a_run_of_slots(spark):
    rng = random.Random(5)
    # a text of a third of all rows, smaller groups over sources and languages, ties of id, nulls
    texts = ["hot text"] * 200 + [f"copy {i % 40} " * (1 + i % 40) for i in range(240)] + [f"single {i}" for i in range(160)] + [None, "", None]
    rows = [(i if i % 50 else 50, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 1) for i, t in enumerate(texts)] + [(None, "hot text", "en", "z", 1)]
    rng.shuffle(rows)
    got = hilbert_shards(spark.createDataFrame(rows, SCHEMA).repartition(5), 7).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    start, at = {}, 0
    for shard in range(7):
        start[shard] = at
        at += sum(r.shard == shard for r in got)
    places, curves = {}, {}
    for r in got:
        places.setdefault((r.text_crc32, r.size), []).append(start[r.shard] + r.slot)
        curves.setdefault((r.text_crc32, r.size), set()).add(r.curve)
    assert all(len(c) == 1 for c in curves.values())
    assert all(sorted(p) == list(range(min(p), min(p) + len(p))) for p in places.values())
    # reruns agree, however the rows are dealt
    again = hilbert_shards(spark.createDataFrame(rows, SCHEMA), 7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_hilbert_neighbours_differ_in_one_step():
    g = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1)
    h = hilbert_index(list(g), 3)
    assert sorted(h) == list(range(512))
    path = g[:, np.argsort(h)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_language(spark, docs, empty):
    french, german = "le chat est sur la table avec les enfants".split(), "der hund ist auf dem tisch mit den kindern".split()
    rng = random.Random(0)
    rows = [(" ".join(rng.choice(w) for _ in range(12)), lang) for lang, w in (("fr", french), ("de", german)) for _ in range(30)]
    model = langid.train_language_model(spark.createDataFrame(rows, "text string, lang string"))
    score = langid.Scorer(model)
    assert score("le chat est la")[0] == "fr" and score("den hund kind")[0] == "de"
    assert score("tischen")[0] == "de"  # an unseen word, by its n-grams
    assert score(None) == score("") == score("123 !") == ("und", 0.0)
    kept = langid.drop_unidentified(docs, model)
    assert kept.columns == docs.columns and {900, 901, 902, 903} & {r.doc_id for r in kept.collect()} == set()
    assert langid.Scorer(langid.train_language_model(empty.select("text", "lang")))("text") == ("und", 0.0)
    few = langid.train_language_model(spark.createDataFrame(rows, "text string, lang string"), max_entries=60)
    assert few.langs == ["de", "fr"] and sum(len(i) for i in few.index.values()) <= 60


def test_sparse_and_dense_models_score_alike(monkeypatch):
    rows = [("a", 0, "le", 5), ("b", 0, "le", 1), ("b", 0, "der", 7), ("a", 2, "le", 4), ("b", 2, "er", 3), ("a", 1, "e", 9), ("b", 1, "e", 2)]
    totals = {(lang, n): 20 + n for lang in "ab" for n in (0, 1, 2)}
    dense = langid.Scorer(langid.LanguageModel(rows, totals))
    monkeypatch.setattr(langid, "DENSE", 0)
    sparse = langid.Scorer(langid.LanguageModel(rows, totals))
    for text in ("le der", "lere", "e", "der er le", "x"):
        assert sparse(text)[0] == dense(text)[0] and abs(sparse(text)[1] - dense(text)[1]) < 1e-6


def test_every_language_is_learned(spark):
    rows = [(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}", f"l{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    score = langid.Scorer(langid.train_language_model(df))
    assert all(score(t)[0] == lang for t, lang in rows)


def test_quality_learns_and_scores_empty_texts(spark, docs, empty):
    rows = [(i, ("Some fine words here. " if i % 2 else "BAD!! WORDS!! ") * 9) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) AS label").unionByName(spark.createDataFrame([(1, None)], "doc_id long, label int"))
    w = quality.train_quality(df, labels)
    got = df.select("doc_id", quality.predict_quality(df, w).alias("s")).collect()
    assert all((r.s > 0.5) == (r.doc_id % 2 == 1) for r in got)
    odd = docs.select("doc_id", quality.predict_quality(docs, w).alias("s")).collect()
    assert len(odd) == docs.count() and all(0 <= r.s <= 1 for r in odd)
    assert not quality.train_quality(empty, labels.limit(0)).any()
    assert empty.select(quality.predict_quality(empty, w)).count() == 0
    long = df.selectExpr("doc_id", "repeat(text, 400) AS text")  # texts of any length teach
    assert quality.train_quality(long, labels).any()


def test_fuzzy_lexicon_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = {"moron": 1, "idiot": 1, "disgusting": 2, "scum": 0}
    lex = toxicity.FuzzyLexicon(terms)
    rng = random.Random(2)
    for _ in range(2000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "o", "i"])
        w = "".join(w)
        near = [distance(w, t) for t, k in terms.items() if distance(w, t) <= k]
        assert lex.edits(w) == (min(near) if near else -1)


def test_toxicity_context_and_rules(spark, docs, empty):
    m = toxicity.Matcher([])
    assert [e for *_, e in m.matches("You idiot, such a m0ron and a morron!")] == [0, 1, 1]
    assert m.features(None) == m.features("") == m.features("a clean text") == (0.0,) * 5
    quoted, plain = 'He said "idiot" is an insult', "You are such an idiot!"
    between = 'She said "yes" you idiot "no" again'
    assert toxicity.window_scores(between, 19, 24)[0] < toxicity.window_scores(between, 10, 13)[0]
    assert toxicity.window_scores("the ‘idiot’ here", 5, 10)[0] >= 0.6
    assert toxicity.window_scores(quoted, 9, 14)[0] > toxicity.window_scores(plain, 16, 21)[0]
    terms, w = model = toxicity.train_toxicity(empty, empty.selectExpr("doc_id", "1 AS label"))
    assert terms == [] and np.allclose(w, toxicity.PRIOR)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.predict_toxicity(docs, model).alias("s")).collect()}
    assert max(got.values()) < 0.5


def test_base_spans_and_redaction(spark, docs, empty):
    text = "Mail a.b@c.org or 10.0.0.256, 10.1.2.3; pay 4111 1111 1111 1111, call +1 (017) 555-7713."
    spans = [(text[s:e], pii.KINDS[k]) for s, k, e in pii.base_spans(text)]
    assert spans == [("a.b@c.org", "email"), ("10.1.2.3", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (017) 555-7713", "phone")]
    assert pii.redacted(text, pii.base_spans(text)) == "Mail [EMAIL] or 10.0.0.256, [IP]; pay [CARD], call [PHONE]."
    df = spark.createDataFrame([(i, f"n {i} {text} tel (017) 555-{1000 + i}") for i in range(200)] + [(900, None)], "doc_id long, text string")
    model = pii.train_spans(df)
    got = {r.doc_id: r.p for r in df.select("doc_id", pii.find_spans(df, model).alias("p")).collect()}
    assert got[900].base_sha256 == hashlib.sha256(b"").hexdigest() and got[900].spans == ""
    want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(f"n 5 {text} tel (017) 555-1005"))
    assert got[5].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[5].n_added >= 1 and got[5].spans.endswith(f"phone:{len('n 5 ' + text) + 5}:{len('n 5 ' + text) + 19}")
    assert pii.train_spans(empty).spans("nothing +1 (017) 555-7713")[0]
    assert docs.select(pii.redact(docs, model).alias("t")).count() == docs.count()


def test_every_kind_keeps_its_share_of_the_examples(spark, monkeypatch):
    mails = " ".join(f"user{j}@mail{j}.org" for j in range(6))
    df = spark.createDataFrame([(i, f"{i} {mails} mail a{i}@b.org tel (017) 555-{1000 + i} call +1 (017) 555-{2000 + i}") for i in range(200)], "doc_id long, text string")
    seen = {}

    def fit(self, x, y, test):
        seen["kinds"] = np.unique(x[:, 0], return_counts=True)
        return self

    monkeypatch.setattr(pii.SpanModel, "fit", fit)
    pii.train_spans(df, max_examples=1_000_000)
    kinds, every = seen["kinds"]
    pii.train_spans(df, max_examples=400)
    assert every.sum() > 400 and 3.0 in kinds and every[list(kinds).index(0.0)] > 400
    assert seen["kinds"][0].tolist() == kinds.tolist() and seen["kinds"][1].sum() == 400
    assert dict(zip(*seen["kinds"], strict=True))[3.0] >= 100


def test_all_texts_teach_once_whatever_their_order(spark):
    texts = [f"{i} call +1 (017) 555-{1000 + i} tel (017) 555-{1000 + i} or 10.0.{i % 300}.7" for i in range(4500)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:50] + ["none", None]], "text string")
    model = pii.train_spans(df)
    given = {t: len(pii.examples(t)) for t in texts}
    tested = sum(n for t, n in given.items() if pii._place_hash(t, -1) % 4 == 3)
    assert (model.taught, model.tested) == (sum(given.values()) - tested, tested)
    again = pii.train_spans(df.repartition(5))
    assert again.least == model.least and min(model.least) <= 1
    x = np.array([e[:-1] for t in texts[:200] for e in pii.examples(t)])
    assert again.predict(x).tolist() == model.predict(x).tolist()


def test_mix_counts_repeated_rows_one_by_one(spark):
    rows = [(1, "w w w w w", "a")] * 1000 + [(i, "w " * 10, "b") for i in range(2, 502)] + [(i, "w " * 5, "c") for i in range(600, 1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(7))
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    for s in "abc":
        taken = sum(r.taken for r in got if r.source == s)
        target = next(r.target for r in got if r.source == s)
        assert abs(target - taken) <= 5
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_mix_shares_by_weight_like_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 30), f"s{rng.randint(0, 9) ** 2 // 4}" if i % 50 else None) for i in range(500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free_ = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free_) for s in free_}
        over = {s for s in free_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free_ -= over
    target |= share
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)


def test_mix_goes_on_past_documents_that_do_not_fit(spark):
    rows = []
    for s in range(12):
        words = [10] * 40 + [120, 260, 420, 700]
        rows += [(1000 * s + i, "w " * n, f"s{s:02d}") for i, n in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2):
        by = {}
        for r in mixing.mix_sources(df, seed=seed).collect():
            t = by.setdefault(r.source, [r.target, 0, r.source_size, []])
            t[1] += r.taken
            t[3].append((r.size, r.copies))
        for target, taken, size, docs_ in by.values():
            whole = int(target / size + 1e-12)
            left = [n for n, c in docs_ if c == whole and n > 0]
            if taken <= target + 1e-6:
                assert not left or 2 * (target - taken) <= min(left) + 1e-6
            else:  # without the last one it would be farther off
                assert any(n > 2 * (taken - target) for n, c in docs_ if c > whole)


def test_base_spans_are_those_of_the_patterns_and_found_in_one_pass():
    import time

    rng = random.Random(11)
    alphabet = ["a", "B", "7", "12", "255", "300", ".", ".", "@", "@", "-", "+", " ", "_", "%", "(", ")", "4111 1111 1111 1111", "é", "x@y.zz", "1.2.3.4"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in pii.BASE[kind].finditer(t) if pii.valid(kind, m[0]))
        assert pii.base_spans(t) == want, t
    began = time.time()
    for t in ("a" * 10**6 + " x@y.zz", "@" + "a" * 10**6, "1" * 10**6, "1." * 10**6, "a@" * 10**5, "+1" * 10**5):
        pii.base_spans(t)
    assert time.time() - began < 10
