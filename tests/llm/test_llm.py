"""Each operator against brute force or the library, and on awkward rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import ann, bpe, common, html_main_text, license_scan, line_dedup, minhash, minhash_dedup, packing, quality_rules, substring_dedup, toxicity, word_table
from quillspark.llm.queries import QUERIES
from quillspark.llm.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, id long, key string, n_words int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and columns named like helpers."""
    texts = [None, "", " \n\t ", "one", "one", LONG, LONG, "a b c d e f g h\n" * 40, "Ünïcödé ΑΣ İ 日本 <|endoftext|> x", "x" * 3000]
    rows = [(i, t, None, "s", None, "g", 7, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "one", None, None, None, None, None, None, None)], SCHEMA)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_bpe_equals_the_library(spark, odd, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = Counter()
    for r in docs.collect():
        ids = ids_of(library, r.text)
        back = library.decode(ids.tolist(), skip_special_tokens=False)
        texts[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs, PATH).collect()) == texts


def test_bpe_of_no_rows_and_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t")], "doc_id long, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in bpe.digests(df, PATH).orderBy("doc_id").collect()] == [(i, 0, nothing, nothing) for i in (1, 2, 3)]
    assert bpe.digests(df.limit(0), PATH).count() == 0 and bpe.encode(df.limit(0), PATH).count() == 0
    ids = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert [r.decoded for r in bpe.decode(ids, PATH).orderBy("doc_id").collect()] == [None, ""]


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(13)
    texts = [bytes(rng.choice(list(b"ab \t\n\r\x0b\x0c\x1c\x85\xa0\x00"), int(n)).astype(np.uint8)) for n in rng.integers(0, 200, 300)]
    texts += [b"", b" ", b"x" * 16, b"x" * 17, b"x" * 18 + b" y", b"y "]
    known = {}
    for text, got in zip(texts, word_table.word_hashes(texts), strict=True):
        words = text.split()
        assert len(got) == len(words)
        for w, h in zip(words, got.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 1000


def test_word_table_against_a_dictionary():
    rng = np.random.default_rng(12)
    table, known = word_table.WordTable(), {}
    for _ in range(60):
        words = [bytes(rng.integers(97, 101, int(n)).astype(np.uint8)) for n in rng.integers(1, 17, 3000)]
        buffer = b" ".join(words) + bytes(word_table.LONGEST)
        sizes = np.array([len(w) for w in words])
        low, high = word_table.halves(buffer, np.cumsum(sizes + 1) - sizes - 1, sizes)
        found = table.find(low, high, sizes.astype(np.uint8))
        assert [f >= 0 for f in found] == [w in known for w in words]
        new = {w: i for i, w in enumerate(words) if w not in known}
        ids = [np.array([len(known) + k] * (1 + len(w) % 3), "<u4").tobytes() for k, w in enumerate(new)]
        one = np.array(list(new.values()), np.int64)
        table.add(low[one], high[one], sizes[one].astype(np.uint8), *table.place(ids))
        known.update(zip(new, ids, strict=True))
        at = table.find(low, high, sizes.astype(np.uint8))
        assert all(table.ids[table.first[a] : table.first[a] + table.count[a]].tobytes() == known[w] for a, w in zip(at.tolist(), words, strict=True))
    assert table.n == len(known) and table.bits > word_table.LEAST_BITS


def test_bpe_round_trip_and_random_words(spark, library):
    codec = bpe.codec(bpe.read_spec(PATH))
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeinotrs'éß<|>1 !"), int(n))) for n in rng.integers(0, 60, 3000)]
    for w, got in zip(words, codec.encode_batch(words), strict=True):
        assert got == ids_of(library, w).tobytes()
        assert codec.decode(got).decode() == library.decode(np.frombuffer(got, "<u4").tolist(), skip_special_tokens=False)
    df = spark.createDataFrame([(1, "Hello you"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert got == {1: "hello</w> you</w>", 2: ""}


def jaccard_groups(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [f"w{i}" for i in range(120)]
    chain = [(10_000 + k, " ".join(base[k * 6 : k * 6 + 60] + [f"z{k}"])) for k in range(8)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(chain, "doc_id long, text string"))
    sets = {r.doc_id: shingle_set(r.text, 4) for r in docs.collect()}
    want = jaccard_groups(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, shingle=4).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize("small, block", [(256, 2_000), (2, 3)])
def test_links_between_members_that_share_no_link_with_the_smallest(spark, monkeypatch, small, block):
    """Families around a text that few of them are near to, compared in packed rows or in blocks."""
    monkeypatch.setattr(minhash, "SMALL_MEMBERS", small)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", block)
    rng = np.random.default_rng(31)
    rows = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(90)]
        for k in range(14):
            words = list(base)
            for i in rng.choice(90, int(rng.integers(1, 9)), replace=False):
                words[i] = f"x{f}y{k}z{i}"
            rows.append((1000 * f + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = jaccard_groups({i: shingle_set(t, 4) for i, t in rows})
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, shingle=4).collect()} == want
    assert len(set(want.values())) > 12


def test_near_duplicates_of_odd_rows(odd):
    got = minhash_dedup.near_duplicates(odd, shingle=4).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].component_id for i in (0, 1, 2, 3, 4, 5, 6)] == [0, 1, 2, 3, 3, 5, 5]
    assert next(r for r in got if r.doc_id is None)["kept"]
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_registers_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    for size in (5, 60, 3000):
        near = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, size * 9 // 10 + 2, dtype=np.uint64)
            a, b = (np.concatenate([x, rng.integers(0, 1 << 63, max(1, size // 20), dtype=np.uint64)]) for _ in range(2))
            regs = minhash.registers(np.concatenate([a, b]), np.array([len(a), len(b)]), 240)
            near.append(float(minhash.estimate(regs[0], regs[1])) - len(x) / (2 * len(a) - len(x)))
        assert abs(np.mean(near)) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (20, 9)] + [(100, i) for i in range(101, 140)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got[5] == got[1] == 1 and got[20] == 8 and got[139] == 100 and len(got) == 4 + 3 + 40
    assert common.components(edges.limit(0)).count() == 0


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_EDGES", 40)
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 300, (2, 200))
    chain = np.arange(1000, 1080)
    a, b = np.r_[a, chain[1:], 2000 + chain], np.r_[b, chain[:-1], np.full(80, 2000)]
    nodes, least = common.least_of_component(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")).collect()}
    alone = set(a[a == b].tolist()) - set(a[a != b].tolist()) - set(b[a != b].tolist())
    assert got == {n: c for n, c in zip(nodes.tolist(), least.tolist(), strict=True) if n not in alone} and got[1079] == 1000


def lines_kept(docs):
    """What is left of each distinct (id, text), by brute force."""
    ids = F.xxhash64("text").alias("h")
    rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in docs.select("doc_id", "text", ids).filter("text IS NOT NULL").collect()})
    lines = [x for *_, t in rows for x in t.split("\n") if x.strip(" \t\n\r\v\f")]
    sets = {x: frozenset(x.lower()[a : a + 8] for a in range(len(x.lower()) - 7)) for x in lines}
    names = {x: n for n, x in enumerate(sets)}
    group = jaccard_groups({names[x]: s for x, s in sets.items()})
    seen, out = set(), {}
    for known, i, _, t in rows:
        left = []
        for x in t.split("\n"):
            if not x.strip(" \t\n\r\v\f") or group[names[x]] not in seen:
                left.append(x)
            if x.strip(" \t\n\r\v\f"):
                seen.add(group[names[x]])
        out[i if known else None, t] = "\n".join(left)
    return out


def test_lines_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    near = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta thetas", "own words of this one row only, and no other"]
    # Repeated rows, shared ids and null ids, with unique lines of their own.
    more = [(0, near[0] + "\n" + near[2]), (0, near[0] + "\n" + near[2]), (0, near[1] + "\nthe second text of a shared id"), (None, near[0]), (None, near[0]), (None, near[1] + "\nanother row without id"), (70_000, None), (70_000, near[0])]
    docs = docs.limit(60).union(spark.createDataFrame(more, "doc_id long, text string"))
    before = docs.collect()
    want = lines_kept(docs)
    got = line_dedup.dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, want.get((r.doc_id, r.text))) for r in before)
    removed = sum(len(t.split("\n")) - len(want[i, t].split("\n")) for i, t in ((r.doc_id, r.text) for r in before) if t is not None and want[i, t])
    assert sum(r.n_removed_lines for r in got) >= removed > 0


def test_lines_of_any_names(spark):
    df = spark.createDataFrame([(1, "one line here\none line here", "g", 5, "r")], "doc_id long, text string, gone string, pos int, quill_gone string")
    got = line_dedup.dedup_lines(df).collect()[0]
    assert (got.text, got.gone, got.pos, got.quill_gone, got.n_lines, got.n_removed_lines) == ("one line here", "g", 5, "r", 2, 1)


def test_long_lines_are_sketched_in_parts():
    line = "".join(f"{i * 7919 % 99991:x}" for i in range(80_000))
    values, number = line_dedup.shingle_values([line])
    assert len(line) > 2 * line_dedup.AT_ONCE and (line_dedup.sketches(["short enough", line])[1] == minhash.registers(values, number, 100)[0]).all()


def test_lines_of_odd_rows(odd):
    got = line_dedup.dedup_lines(odd)
    assert set(odd.columns) <= set(got.columns) and got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert by[0].text is None and by[7].text.startswith("a b c d e f g h\n") is False or by[7].n_removed_lines == 39
    assert by[6].text == "" and by[5].text in ("", LONG)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_repeated_passages_go_once(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(80)) + (f" {passage} " if i % 2 else " ") + " ".join(word() for _ in range(50 + i))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    for i, t in rows:
        assert (got[i].text == t) == (i % 2 == 0 or i == 1)
    assert all(35 <= got[i].n_removed_words <= 60 for i in (3, 5, 7, 9))


def test_every_repeated_passage_of_51_words_goes(spark):
    rng = np.random.default_rng(51)
    word = lambda n: [f"{x:x}" for x in rng.integers(0, 1 << 40, n).tolist()]
    rows = []
    for p in range(400):
        passage = word(51)
        for copy in range(3):
            rows.append((3 * p + copy, " ".join([*word(int(rng.integers(0, 60))), *passage, *word(int(rng.integers(0, 60)))]), passage))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    for i, text, passage in rows:
        words, own = text.split(), got[i].text.split()
        if i % 3 == 0:
            assert got[i].text == text
        else:
            assert 34 <= got[i].n_removed_words == len(words) - len(own) <= 51
            # What went is in the passage: all words around it stay.
            gone = set(words) - set(own)
            assert gone <= set(passage) and len(gone) == got[i].n_removed_words


def test_chunks_that_only_occurred_apart_stay(spark):
    rng = np.random.default_rng(52)
    word = lambda n: [f"{x:x}" for x in rng.integers(0, 1 << 40, n).tolist()]
    phrases = [word(14) for _ in range(6)]
    rows = [(i, " ".join([*word(20), *p, *word(20)])) for i, p in enumerate(phrases)] + [(6, " ".join(w for p in phrases for w in p))]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows)


def test_substrings_of_repeated_rows_shared_and_null_ids(spark):
    rng = np.random.default_rng(53)
    text = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, n).tolist())
    x, y, z, n = text(120), text(120), text(120), text(120)
    rows = [(0, x), (1, x), (1, y), (2, z), (2, z), (None, n), (None, n), (3, n), (4, z)]
    df = spark.createDataFrame([(*r, "own", 5) for r in rows], "doc_id long, text string, doc string, row int")
    got = Counter((r.doc_id, r.text, r.doc, r.row) for r in substring_dedup.dedup_substrings(df).collect())
    left = Counter()
    for (i, t, *_), k in got.items():
        left[i, len(t.split()) > 100] += k
        assert t in (x, y, z, n) or len(t.split()) <= 18
    # Rows equal in id and text are one document; the first place of every passage stays.
    assert left == Counter({(0, True): 1, (1, True): 1, (1, False): 1, (2, True): 2, (None, True): 2, (3, False): 1, (4, False): 1})


def test_substrings_of_odd_rows(odd):
    got = substring_dedup.dedup_substrings(odd)
    assert set(odd.columns) <= set(got.columns) and got.count() == odd.count()
    assert {r.doc_id: r.text for r in got.collect()}[0] is None
    assert substring_dedup.dedup_substrings(odd.limit(0)).count() == 0


def test_substrings_equal_brute_force(spark):
    """Every stretch of chunks, as its words, in order of id, text hash and number: what came before goes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.filter("doc_id % 10 = 0").select(F.lit(3).cast("long"), "text")).union(docs.filter("doc_id % 20 = 0").select(F.lit(None).cast("long"), "text"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    places = {}
    for i, t, h in rows:
        words = (t or "").encode().split()
        ends = substring_dedup.chunk_ends(words)
        chunks = [tuple(words[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        n = min(substring_dedup.JOINED, len(chunks))
        for k in range(len(chunks) - n + 1 if n else 0):
            places.setdefault(tuple(chunks[k : k + n]), set()).add((i is not None, i or 0, h, k))
    marks = {}
    for at in places.values():
        first = min(at)
        for known, i, h, k in at - {first}:
            marks.setdefault((i if known else None, h), set()).update(range(k, k + substring_dedup.JOINED))
    want = Counter((i, substring_dedup.without(t, marks.get((i, h), set()), substring_dedup.MIN_WORDS)[0]) for i, t, h in rows)
    got = substring_dedup.dedup_substrings(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == want and sum(r.n_removed_words for r in got) > 0


def test_insertions_keep_later_borders():
    words = [f"w{i * 7919 % 1009}".encode() for i in range(400)]
    a = {tuple(words[x:y]) for x, y in zip([0, *substring_dedup.chunk_ends(words)], substring_dedup.chunk_ends(words), strict=False)}
    more = words[:50] + [b"inserted"] + words[50:]
    b = {tuple(more[x:y]) for x, y in zip([0, *substring_dedup.chunk_ends(more)], substring_dedup.chunk_ends(more), strict=False)}
    assert len(a - b) <= 3


def test_quality_rules(spark, odd):
    got = {r.doc_id: r for r in quality_rules.judge(odd, order=list(quality_rules.RULES)).collect()}
    assert not got[0].kept and got[0].base_failed and got[7].n_dup_lines == 39 and got[7].n_repeat_words == 320
    assert got[5].n_words == 20_000
    kept = quality_rules.keep(spark.read.parquet(f"{SF}/documents.parquet"))
    judged = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged.collect())
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_quality_rules_of_any_names(spark):
    df = spark.createDataFrame([(1, "a! b! c! d! " * 6, "x", "y", 3)], "doc_id long, text string, q_text string, q_mark string, q_row int")
    got = quality_rules.judge(df, report=("n_words",)).collect()[0]
    assert (got.q_text, got.q_mark, got.q_row, got.n_words) == ("x", "y", 3, 24) and "n_exclamations" not in got.asDict()
    assert quality_rules.measures(df, names=("n_words",)).columns == [*df.columns, "n_words"]


def test_the_cascade_stops_at_the_first_failure(spark):
    """Whatever the order, the same texts stay; what an earlier rule rejects is measured no further."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ways = [list(quality_rules.RULES), list(quality_rules.RULES)[::-1]]
    kept = [{r.doc_id for r in quality_rules.judge(docs, order=w, report=()).filter("kept").collect()} for w in ways]
    assert kept[0] == kept[1] == {r.doc_id for r in quality_rules.keep(docs, order=ways[1]).collect()}
    short = spark.createDataFrame([(1, "few! words!")], "doc_id long, text string")
    plan = quality_rules.judge(short, order=ways[0], report=())
    assert plan.collect()[0].rejected_by == "too_short"
    found = quality_rules.cascade_order(docs)
    assert [n for n, *_ in found] == [n for n, *_ in sorted(found, key=lambda r: -r[2] / r[1])] and all(c > 0 and 0 <= s <= 1 for _, c, s in found)


def test_packing(spark, odd, library):
    got = packing.pack_documents(odd, PATH, room=256).collect()
    want = Counter()
    for r in odd.collect():
        ids = np.append(ids_of(library, r.text), 1).astype("<u4")
        for k, a in enumerate(range(0, len(ids), 256)):
            want[r.doc_id, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    # Of the four rests, 250, 212, 193 and 65 tokens, no two fit in one sequence.
    assert max(at.values()) <= 256 and len(at) == sum(v == 256 for v in at.values()) + 4
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0


def test_genetic_operators_keep_all_items():
    rng = np.random.default_rng(0)
    length = rng.integers(1, 100, 200).tolist()
    a = packing.best_fit(list(range(200)), length, 128)
    b = packing.mutate(a, length, 128, rng)
    for bins in (b, packing.crossover(a, b, length, 128, rng), packing.evolve(length, 128, 1, [a, b])):
        assert sorted(i for x in bins for i in x) == list(range(200)) and all(sum(length[i] for i in x) <= 128 for x in bins)
    assert packing.fewest([65, 66, 1], 128) == 2


def triplets(n, seed):
    """Lengths of which three always fill 1,000, mixed up."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2))
        out += [a, b, 1000 - a - b]
    return rng.permutation(out).tolist()


def test_evolution_beats_best_fit_where_this_is_not_the_best():
    for seed in range(5):
        length = triplets(30, seed)
        first = packing.best_fit(list(range(90)), length, 1000)
        assert len(first) >= 34 and len(packing.evolve(length, 1000, seed, [first], 100)) <= 31


def test_the_elite_of_an_island_migrates(spark):
    """A guest's bins enter the population: with the best packing as guest, no generation is needed to keep it."""
    length = triplets(20, 7)
    poor = [[i] for i in range(60)]
    good = packing.evolve(length, 1000, 1, [packing.best_fit(list(range(60)), length, 1000)], 60)
    assert packing.evolve(length, 1000, 2, [poor, good], 0) == good
    rows = [(i, 0, 0, n, 0, i * 7919 % 61) for i, n in enumerate(length)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")
    got = packing.pack(items, 1000).collect()
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert sorted(r.doc_id for r in got) == list(range(60)) and max(used.values()) <= 1000
    assert 20 <= len(used) < len(packing.best_fit(list(range(60)), length, 1000))


def test_sequences_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, PATH).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 4096 for r in got)
    assert len(got) <= -(-sum(r.n for r in got) // 4096) + 1


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8)).round(3)
    x[100:130] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [None] * 8), (None, [1.0] * 8), (2400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, 10).collect()
    assert {r.query_id for r in got} == set(range(0, 900, 50)) and len(got) == 180
    hit = 0
    for q in range(0, 900, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        true = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        hit += len({r.vec_id for r in own} & set(true))
    assert hit >= 0.9 * 180
    few = ann.search(df.filter("vec_id < 4"), F.col("vec_id") == 0, 10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_of_repeated_rows_and_hot_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "PLACE", 50)
    rng = np.random.default_rng(21)
    x = np.r_[np.tile(rng.standard_normal(6), (400, 1)), rng.standard_normal((300, 6))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (650, x[650].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6), F.col("vec_id").isin(0, 650), 10).collect()
    hot = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 0)
    assert [v for _, v, _ in hot][:10] == list(range(1, 11)) and all(d == 0 for *_, d in hot)
    assert not any(r.vec_id == 650 for r in got if r.query_id == 650)


def test_neighbours_of_every_length(spark):
    rng = np.random.default_rng(8)
    x = {5: rng.standard_normal((12, 5)), 8: rng.standard_normal((60, 8)), 3: rng.standard_normal((2, 3)), 4: rng.standard_normal((1, 4))}
    rows = [(100 * n + i, v.tolist()) for n, own in x.items() for i, v in enumerate(own)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10).collect()
    for n, own in x.items():
        d = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
        want = [100 * n + i for i in np.argsort(d).tolist() if i][:10]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100 * n), key=lambda r: r.rank)] == want


def test_toxicity(spark, odd):
    docs = [(i, ("you utter nincompoop " if i % 4 == 0 else "a kind and gentle ") + " ".join(f"w{(i * 31 + k * 7) % 300}" for k in range(20))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = toxicity.classify(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert toxicity.classify(odd, labels.limit(0)).filter("score = 0").count() == odd.count()
    assert toxicity.classify(odd.limit(0), labels).count() == 0


def test_toxicity_of_held_out_rows(spark):
    """Scores are those of the fitted weights, and hold on rows that taught nothing."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, bias = model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows[:300]:
        z = sum(float(weights[b]) for b in toxicity.features(r.text)) + bias
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    hit, said, true = sum(r.predicted and r.toxic for r in held), sum(r.predicted for r in held), sum(r.toxic for r in held)
    assert hit >= 0.9 * said and hit >= 0.5 * true


def test_teaching_rows_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_BYTES", 1 << 12)
    docs = spark.createDataFrame([(i % 50, f"{'bad' if i % 2 else 'good'} " + " ".join(f"w{i}x{k}" for k in range(100))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == 400


def test_main_text(spark):
    page = "<html><head><title>t</title><script>var t='</p><p>no'</script></head><body><nav><a>Menu</a></nav><article><h1>Head &amp; line</h1><p><b>One\n two<br><p>Short.<div class='comments'><p>I disagree</p></div></article><footer>f</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p")], "page_id long, url string, html string")
    assert [r.text for r in html_main_text.extract(df).orderBy("page_id").collect()] == ["Head & line\nOne two\nShort.", "", "", "<p"]
    assert html_main_text.extract(df.limit(0)).count() == 0


def test_main_text_by_line_blocks():
    body = "".join(f"<p>{'plain words here ' * 12}</p>" for _ in range(4))
    page = f"<body><div class='menu'>Home</div><div><p>x</p></div><div>{body}<p>End.</p></div><div id='comments'><p>{'me too ' * 60}</p></div>"
    got = html_main_text.main_text(page).split("\n")
    assert len(got) == 5 and got[-1] == "End."


def test_licenses(spark, odd):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, "a license to err"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "w " * 400 + "Licensed under CC BY-NC 4.0. " + "w " * 400)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line, r.license) for r in got) == [(1, 1, "Apache-2.0"), (2, 0, "MIT"), (4, 0, "GPL-3.0"), (5, 0, "CC-BY-NC-4.0")]
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(odd.limit(0)).count() == 0


def test_main_text_keeps_all_regions_and_what_lies_between():
    long = [f"{w} {'plain words here ' * 8}".strip() for w in ("one", "two", "three", "four", "five")]
    items = ["flour", "eggs", "milk", "salt", "a pan"]
    part = lambda texts: "<div>" + "".join(f"<p>{x}</p>" for x in texts) + "</div>"
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    post = f"<div class=post>{part(long[:3])}{listed}{part(long[3:])}</div>"
    page = f"<body><nav>Home</nav><div class=teaser>More</div>{post}<div class=comments>{part(long)}</div><footer>f</footer></body>"
    assert html_main_text.main_text(page).split("\n") == long[:3] + items + long[3:]
    # Regions whose only common element is the body keep all that isn't matter.
    assert html_main_text.main_text(f"<body><nav>Home</nav>{part(long[:1])}{listed}{part(long[1:])}<footer>f</footer>").split("\n") == long[:1] + items + long[1:]
    # An article that holds a region of its own stays beside that of the most text.
    both = f"<article>{part(long[:3])}</article><p>a</p><p>b</p><p>c</p><article>{listed}{part(long[3:])}</article>"
    assert html_main_text.main_text(both).split("\n") == long[:3] + items + long[3:]


def prose(n, size=12):
    return [f"{w} {'plain words here ' * size}".strip() for w in ("one", "two", "three", "four", "five", "six")[:n]]


def paragraphs(texts):
    return "".join(f"<p>{x}</p>" for x in texts)


def test_main_text_where_names_say_nothing():
    """Neither tags nor classes tell the article from the rest: line blocks do."""
    menu = "<div class=x1><ul>" + "".join(f"<li><a href=/{i}>Item {i} of the long menu of this page</a></li>" for i in range(8)) + "</ul></div>"
    body = paragraphs([*prose(2), "Short.", *prose(4)[2:]])
    page = f"<body><div class=x0>The Daily Page</div>{menu}<div class=x2><h1>Title</h1><div class=x3>{body}<p>End.</p></div></div><div class=x4>Imprint, all kinds of small print</div></body>"
    want = ["Title", *prose(2), "Short.", *prose(4)[2:], "End."]
    assert html_main_text.main_text(page).split("\n") == want
    found, elements = html_main_text.lines(page)
    assert len(found) > len(want) + 8 and not any(e.hinted for e in elements)
    # Right in the body, with the rest in boxes of its own.
    flat = f"<body><div class=x0>The Daily Page</div>{menu}<h1>Title</h1>{body}<p>End.</p><div class=x4>Imprint, all kinds of small print</div></body>"
    assert html_main_text.main_text(flat).split("\n") == want


def test_main_text_under_misleading_names():
    body = paragraphs(prose(3))
    assert html_main_text.main_text(f"<body><div class='entry-content has-sidebar'>{body}</div><div class='sidebar'>More</div></body>").split("\n") == prose(3)
    assert html_main_text.main_text(f"<body><article><div class='post-header'><h1>Head</h1></div>{body}</article></body>").split("\n") == ["Head", *prose(3)]
    assert html_main_text.main_text(f"<body><article><div class='widget'>{body}</div></article></body>").split("\n") == prose(3)
    # A hint is passed over where nothing else holds a region, a plain name isn't.
    assert html_main_text.main_text(f"<body><p>x</p><div class='newsletter-layout'>{body}</div></body>").split("\n") == prose(3)
    assert html_main_text.main_text(f"<body><p>Few words.</p><div class='comments'>{body}</div></body>") == "Few words."


def test_long_and_repeated_pages(spark):
    page = f"<article>{paragraphs(prose(6, 4000))}</article>"
    got = html_main_text.extract(spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, page)], "page_id long, url string, html string")).collect()
    assert [(r.text, r.n_chars) for r in got] == [("\n".join(prose(6, 4000)), sum(map(len, prose(6, 4000))) + 5)] * 3
    assert html_main_text.main_text("<div>" * 30_000 + "deep" + "<p>x") == "deep\nx"


def test_pages_equal_the_article_blocks(spark):
    """The test pages hold one article; its blocks, cut out by plain patterns, are the truth."""
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)
        texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)
        assert html_main_text.main_text(r.html) == "\n".join(t for t in texts if t)


def test_line_blocks_alone_find_most_articles(spark, monkeypatch):
    """Without any knowledge of names, most pages give the same text: the blocks decide."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [html_main_text.main_text(p) for p in pages]
    for name in ("NEVER_TEXT", "HINTS", "ROLES", "CONTENT"):
        monkeypatch.setattr(html_main_text, name, frozenset({"head"}) if name == "NEVER_TEXT" else frozenset())
    lines = ["\n".join(x.text for x in html_main_text.lines(p)[0]) for p in pages]
    assert not any(a == b for a, b in zip(lines, want, strict=True))
    assert sum(html_main_text.main_text(p) == w for p, w in zip(pages, want, strict=True)) >= 0.75 * len(pages)


def names_of(text):
    return sorted((line, name) for line, name, *_ in license_scan.scan_text(text))


def test_notices_in_prose():
    prose = "The parser that this chapter describes was first written by two students in a summer. Released under the MIT License."
    longer = "We thank everyone who sent corrections over the years, most of all the readers of the first edition. Licensed under the Apache License, Version 2.0. The figures were drawn anew for this edition by hand."
    assert names_of(prose) == [(0, "MIT")] and names_of(longer) == [(0, "Apache-2.0")]


def test_notices_over_lines_and_several_of_a_line():
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files, to deal in it\n"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n"
    mpl = "x\n// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed"
    two = "Licensed under the MIT License. or Licensed under the Apache License, Version 2.0."
    assert names_of(mit) == [(0, "MIT")] and names_of(bsd) == [(0, "BSD-3-Clause")] and names_of(mpl) == [(1, "MPL-2.0")]
    assert names_of(two) == [(0, "Apache-2.0"), (0, "MIT")]
    assert names_of("a license to err, under the MIT\n\nLicense. We like the MIT License") == []
    for name, notices in license_scan.TEMPLATES.items():
        for notice, _ in notices:
            words = notice.split(" ")
            for k in range(1, len(words)):
                text = "some words before it\n" + " ".join(words[:k]) + "\n# " + " ".join(words[k:]) + "\nand after it"
                assert (1, name) in names_of(text), (name, k)


def test_every_license_of_an_expression_and_its_spellings():
    assert names_of("Under the Apache License, Version 2.0 or the MIT License, at your choice.") == [(0, "Apache-2.0"), (0, "MIT")]
    assert names_of("license = MIT OR Apache-2.0") == [(0, "Apache-2.0"), (0, "MIT")] == names_of("license = Apache-2.0 OR MIT")
    assert names_of("under the GNU General Public License v3.0") == [(0, "GPL-3.0")] == names_of("covered by the GNU GPLv3")
    assert names_of("the GNU GPL version 2 applies") == [(0, "GPL-2.0")] and names_of("Released under the MIT licence.") == [(0, "MIT")]
    assert names_of("the GNU Lesser General Public License version 3") == [(0, "LGPL-3.0")] == names_of("SPDX-License-Identifier: LGPL-3.0-or-later")
    assert names_of("the GNU Affero General Public License version 3") == [(0, "AGPL-3.0")] == names_of("GNU AGPLv3 here")
    assert names_of("the GNU Library General Public License version 2") == [] == names_of("License: LGPL-2.0")
    assert names_of("Licensed under CC BY-SA 4.0") == [(0, "CC-BY-SA-4.0")]


def test_every_template_is_tried_by_compression_and_the_ranking_decides(monkeypatch):
    seen = []
    asked = license_scan.ranking
    monkeypatch.setattr(license_scan, "ranking", lambda block: seen.append(asked(block)) or seen[-1])
    longest = {name: max((text for text, _ in notices), key=len) for name, notices in license_scan.TEMPLATES.items()}
    families = ("BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "BSL-1.0")
    for name in families:
        assert names_of(f"Copyright 2020\n\n{longest[name]}\nand more") == [(2, name)]
    assert names_of("we thank the license committee for a permission") == []  # no telling words, tried all the same
    assert len(seen) > len(families) and all(r.keys() == license_scan.TEMPLATES.keys() and list(r.values()) == sorted(r.values(), reverse=True) for r in seen)
    monkeypatch.setattr(license_scan, "ranking", lambda block: dict.fromkeys(license_scan.TEMPLATES, 0))
    assert any(names_of(longest[name]) != [(0, name)] for name in families)


def test_telling_words_hold_what_blocks_are_cut_around():
    for name, _, telling, _ in license_scan._notices():
        assert any(w in license_scan._ANCHORS for w in telling.split()), (name, telling)
        assert any(m in telling for m in license_scan._MENTIONS) or license_scan._OTHERS.search(telling), (name, telling)
    rng = np.random.default_rng(7)
    words = [str(w) for w in rng.choice(["license", "mit", "or", "apache", "w", "x"], 4000)]
    stretches = list(license_scan.blocks(words))
    assert [i for i, w in enumerate(words) if w in license_scan._ANCHORS and sum(a <= i < b for a, b in stretches) != 1] == []


def test_later_versions_identifiers_and_short_forms():
    later = "it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version."
    assert names_of(later) == [(0, "GPL-2.0")] and names_of(later.replace("version 2", "version 3").replace("GNU General", "GNU Lesser General")) == [(0, "LGPL-3.0")]
    for text, name in (("Licensed under Apache License 2.0", "Apache-2.0"), ("License: MIT", "MIT"), ("Mozilla Public License 2.0", "MPL-2.0"), ("Boost Software License - Version 1.0", "BSL-1.0"), ("under the zlib license", "Zlib"), ("GPL-2.0 OR MIT", "MIT"), ("2.0 OR MIT", "MIT")):
        assert names_of(text) == [(0, name)], text
    for name in license_scan.TEMPLATES.keys() - {"all-rights-reserved"}:
        assert names_of(f"// SPDX-License-Identifier: {name}") == [(0, name)], name


def test_scans_equal_the_confirmation_of_every_template(spark):
    """Brute force: each template at each of its telling words, whatever else stands there."""
    for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text rlike '(?i)licen|apache|gpl|mit|cc|reserved'").collect():
        low = (r.text or "").lower()
        want = set()
        for paragraph in license_scan.paragraphs(low):
            words = [w for w, _, _ in paragraph]
            for name, wanted, telling, place in license_scan._notices():
                told = telling.split()
                for i in range(len(words) - len(told) + 1):
                    if words[i : i + len(told)] == told and license_scan.confirm(words, wanted, i, place):
                        want.add(name)
        assert {name for _, name, *_ in license_scan.scan_text(r.text)} == want


def test_every_document_with_a_planted_notice_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    notice = F.col("text").rlike("MIT License|Apache License|General Public License|CC BY-NC|All rights reserved")
    want = {r.doc_id for r in docs.filter(notice).collect()}
    assert {r.doc_id for r in license_scan.scan(docs).collect()} == want and want


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns and out.count() <= n
        docs, n = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


def test_pipeline_stages_on_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars")
    rows = rows.union(spark.createDataFrame([(11, " ".join(f"plain{i}" for i in range(40)), None, None, None)], rows.schema))
    # The long texts repeat themselves; the others are too short.
    assert {r.doc_id for r in stages["quality_rules"](spark, rows, SF).collect()} == {11}
    want = lines_kept(rows)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in stages["line_dedup"](spark, rows, SF).collect()) == Counter((r.doc_id, t, None if t is None else len(t)) for r in rows.collect() for t in [want.get((r.doc_id, r.text))])
    one = Counter(r.doc_id for r in stages["minhash_dedup"](spark, rows, SF).collect())
    assert one == Counter([0, 1, 2, 3, 3, 5, 7, 8, 9, 11, None])
    free = {r.doc_id: r.text for r in stages["substring_dedup"](spark, rows, SF).collect()}
    # The long text begins anew after 977 * 13 words.
    assert free[5].startswith(" ".join(LONG.split()[: 977 * 13])) and len(free[5].split()) < 977 * 13 + 20
    assert len(free[6].split()) < 20 and free[0] is None and free[3] == "one"
    pieces = stages["best_fit_packing"](spark, rows, SF)
    assert pieces.filter("piece = 0").count() == rows.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), SF).count() == 0, name


def test_quality_query_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = c.sql(sql).to_arrow_table().to_pylist()
        got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
        assert sorted(map(str, (sorted(r.items()) for r in got))) == sorted(map(str, (sorted(r.items()) for r in want)))
