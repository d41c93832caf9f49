"""Each operator on odd rows and on an empty table, against brute force where results are exact."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strataday.llm import (  # noqa: E402
    components, decontaminate, exact_dedup, language_model, mixing, near_dup, quality, repeats, token_counts,
    token_ids, toxicity,
)

from .conftest import passage  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def test_token_counts_match_the_library(docs, empty, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, PIECES, 100).collect() if r.doc_id is not None}
    table = token_counts.PrefixTable(PIECES)
    for i, t in texts.items():
        assert got[i].n_tokens == len(model.encode(t)) and got[i].n_bytes == len(t.encode())
        assert got[i].over_limit == (got[i].n_tokens > 100)
        counts = table.table(t[:3000])
        if len(t) < 3000:
            assert got[i].cut == max(k for k, c in enumerate(counts) if c <= 100)
    short = texts[14]
    assert table.table(short) == [len(model.encode(short[:k])) for k in range(len(short) + 1)]
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_elias_fano_round_trip():
    rng = np.random.default_rng(3)
    for n, step in ((1, 5), (2, 1), (200, 300), (500, 2)):
        values = np.cumsum(rng.integers(0, step, n))
        held = token_ids.EliasFano(token_ids.EliasFano.encode(values))
        assert (held.all() == values).all() and [held.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        held.select(500)


def test_token_ids_come_back(spark, docs, empty, rows, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    token_ids.write_token_ids(docs, str(tmp_path / "a"), WORDS, 2, 3)
    got = token_ids.read_documents(spark, str(tmp_path / "a")).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, want in zip(got, order, strict=True):
        ids = [*library.encode(want[1] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (want[0], start, len(ids), ids)
        start += len(ids)
    digest = {r.start: r.ids_crc32 for r in token_ids.document_digests(spark, str(tmp_path / "a")).collect()}
    assert digest == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    token_ids.write_token_ids(empty, str(tmp_path / "b"), WORDS, 2)
    assert token_ids.read_documents(spark, str(tmp_path / "b")).count() == 0


def test_exact_dedup_and_a_second_batch(spark, docs, empty, texts, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    got = {r.doc_id: r for r in exact_dedup.dedup_against(index, docs).collect()}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    for same in groups.values():
        for i in same:
            assert got[i].keep_id == min(same) and got[i].kept == (i == min(same))
    assert got[2].keep_id == 0 and got[4].keep_id == 3 and got[None].kept
    before = index.rows().count()
    later = spark.createDataFrame([(100, texts[0]), (101, "new"), (102, "new")], "doc_id long, text string")
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_against(again, later).collect()}
    assert got == {100: (0, False), 101: (101, True), 102: (101, False)}
    assert again.rows().count() == before + 1
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_repeats_match_brute_force(docs, empty, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            own = raw[p : p + 100]
            if own in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(own)
        left = bytes(x for x, y in zip(raw, gone) if not y)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in repeats.without_repeats(docs).collect()}
    assert got.pop(None)[1] == 0
    assert got == want and want[10][1] > 0 and want[11][1] > 4000
    assert repeats.without_repeats(empty).count() == 0


def test_crowded_anchors_are_settled_alike(spark, monkeypatch):
    line = "the very same line of more than one hundred bytes stands in each of these documents, between others " * 2
    rows = [(i, f"{i} {i * 7} " + line + f" {i * 13}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, repeats.without_repeats(docs).collect()))
    found = repeats._settle_anchors

    def crowd(batches):
        for b in found(batches):
            kind = np.where(np.asarray(b.column("kind")) == repeats.OPEN, repeats.CROWDED, np.asarray(b.column("kind")))
            yield b.set_column(0, "kind", __import__("pyarrow").array(kind.astype(np.int32)))

    monkeypatch.setattr(repeats, "_settle_anchors", crowd)
    assert sorted(map(tuple, repeats.without_repeats(docs).collect())) == plain


def shingles(text):
    w = split(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_dup_matches_brute_force(docs, empty, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
    got = {r.doc_id: r for r in near_dup.near_dup(docs).collect() if r.doc_id is not None}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), root[i]) for i in sets}
    assert got[1].component_id == 0 and got[7].component_id == 6 and got[4].component_id == 4
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and 1 not in {r.doc_id for r in kept.collect()}
    assert near_dup.near_dup(empty).count() == 0


def test_near_dup_adds_trees_until_pairs_are_found(spark, monkeypatch):
    r, near = random.Random(8), {}
    texts = []
    for k in range(30):
        base = passage(1000 + k, 164)
        # 4 changed words within lose 5 of 160 shingles each, those at the ends one each.
        copy = [f"new{r.randrange(10**9)}" if j % 40 == 20 or j in (0, 163) else w for j, w in enumerate(base)]
        texts += [" ".join(base), " ".join(copy)]
        a, b = shingles(texts[-2]), shingles(texts[-1])
        assert 0.75 <= len(a & b) / len(a | b) < 0.8
        near[2 * k + 1] = 2 * k
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dup, "TREES", 1)
    got = {h.doc_id: h.component_id for h in near_dup.near_dup(docs).collect()}
    assert got == {i: near.get(i, i) for i in got} and len(got) == 60


def test_odds_of_missing_a_pair_grow_with_depth():
    assert [round(near_dup.missed(d, 16), 3) for d in (8, 12, 16)] == [0.008, 0.036, 0.078]
    assert near_dup.missed(16, 64) < near_dup.missed(16, 16) and near_dup.missed(4, 16) < 1 - near_dup.RECALL


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_alignment_scores():
    word = np.arange(1, 21).astype(np.uint64)
    gap = np.delete(word, [5, 6])
    other = word.copy()
    other[3] = 99
    got = decontaminate.align(word, [word, gap, other, word[::-1].copy(), np.arange(50, 90).astype(np.uint64)])
    assert got.tolist() == [40, 34, 37, 2, 0]


def test_contaminated_finds_edited_copies(spark, docs, empty, texts):
    item = texts[15].split()[40:80]
    edited = [*item[:10], "other", *item[11:25], *item[26:]]
    more = spark.createDataFrame([(50, "start " + " ".join(edited).upper().replace("Ö", "ö") + " end"), (51, " ".join(item[:6]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "zz"), (10, "")], "item_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(both, bench).collect()}
    assert set(got) == {(15, 7), (50, 7)} and got[15, 7] == 1.0 and got[50, 7] > 0.8
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_matches_alignment_of_whole_texts(spark):
    r = random.Random(5)
    items = [passage(100 + i, r.randint(16, 59)) for i in range(12)]
    copies = [list(item) for item in items for _ in range(2)]
    for share in (0.15, 0.2, 0.25, 0.3):
        for item in items:
            copies.append([f"new{r.randrange(10**9)}" if r.random() < share else w for w in item])
    held = [passage(200 + k, 5) + copy + passage(300 + k, 5) for k, copy in enumerate(copies)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(held)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    coded = lambda ws: np.array([zlib.crc32(w.encode()) for w in ws], np.uint64)
    grams = lambda ws: {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}
    want = {}
    for i, item in enumerate(items):
        scores = decontaminate.align(coded(item), [coded(t) for t in held]) / (2 * len(item))
        want |= {(k, i): s for k, (t, s) in enumerate(zip(held, scores)) if s >= 0.5 and grams(item) & grams(t)}
    got = {(h.doc_id, h.item_id): h.score for h in decontaminate.contaminated(docs, bench).collect()}
    assert len(want) > 55 and got == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert {h.doc_id for h in left.collect()} == set(range(len(held))) - {k for k, _ in want}


def test_alignments_with_long_gaps_are_found(spark):
    item = [f"item{k}" for k in range(20)]
    apart = [w for k in range(9, 20, 2) for w in (*item[k : k + 2], f"between{k}")]
    held = [item[:9] + [f"foreign{k}" for k in range(12)] + apart, apart[::-1] + item[:3]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(held)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    coded = lambda ws: np.array([zlib.crc32(w.encode()) for w in ws], np.uint64)
    scores = decontaminate.align(coded(item), [coded(t) for t in held]) / (2 * len(item))
    got = {h.doc_id: h.score for h in decontaminate.contaminated(docs, bench).collect()}
    assert scores[0] >= 0.5 > scores[1] and got == {0: scores[0]}


def test_mixing_targets_and_totals(spark, docs, empty, rows):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(split(r[1] or ""))
    order = [*sorted(s for s in size if s is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = 1.5 * sum(size.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.copies <= 2
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, got))
    assert mixing.mix_documents(docs).count() == sum(r.copies for r in got)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mixing(empty).count() == 0


def test_mix_comes_near_its_targets_with_repeated_and_missing_ids(spark):
    r = random.Random(11)
    rows = [(None if i % 3 == 0 else i // 2 + 2**60, f"{i} " + "w " * r.randint(0, 80), r.choice("aaaabbc")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for got in (mixing.mixed(docs).collect(), mixing.mixed(docs.repartition(5)).collect()):
        assert Counter(x.doc_id for x in got) == Counter(x[0] for x in rows)
        taken, target, largest = Counter(), {}, Counter()
        for x in got:
            taken[x.source] += x.size * x.copies
            target[x.source] = x.target
            largest[x.source] = max(largest[x.source], x.size)
        # What is left to the landing is less than two documents of a source.
        assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    mix = Counter((x.doc_id, x.text, x.source) for x in mixing.mix_documents(docs).collect())
    assert set(mix) <= set(rows) and max(mix.values()) <= 2
    words = Counter()
    for (_, text, source), n in mix.items():
        words[source] += n * len(split(text))
    assert all(abs(words[s] - target[s]) <= 2 * largest[s] for s in target)


def test_quality_learns_from_few_rows_with_few_bad_ones(spark):
    from .conftest import passage

    good_rows = [(i, " ".join(passage(i, 30)), 1) for i in range(220)]
    bad_rows = [(1000 + i, " ".join(f"{w} {m}" for w, m in zip(passage(900 + i, 10), 10 * ["***", "###"])), 0) for i in range(30)]
    table = spark.createDataFrame(good_rows + bad_rows, "doc_id long, text string, quality int")
    truth = {i: y for i, _, y in good_rows + bad_rows}
    held = [r for r in quality.quality(table.select("doc_id", "text"), table.select("doc_id", "quality")).collect() if r.held_out]
    assert sum(truth[r.doc_id] == 0 for r in held) > 3 and all(r.predicted == truth[r.doc_id] for r in held)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(5)
    p, x = rng.uniform(0.1, 0.9, 400), rng.integers(1, 500, 400).astype(float)
    out = mixing.fly(p, x, np.random.default_rng(1), False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert math.isclose(out.sum(), p.sum(), rel_tol=1e-6) and math.isclose(out @ x, p @ x, rel_tol=1e-6)
    assert set(mixing.fly(p, x, np.random.default_rng(1), True)) <= {0.0, 1.0}


def test_language_model_matches_brute_force(docs, empty, texts):
    got = {r.doc_id: r for r in language_model.language_model(docs).collect() if r.doc_id not in (None, 9)}
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    tokens = [[*split(lower(t)), ""] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total = sum(count.values())
    for (i, _), t, h in zip(rows, tokens, held):
        if i in got:
            base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t)
            r = got[i]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (h, len(t), total)
            assert r.n_known == sum(count[w] > 0 for w in t) and math.isclose(r.base_score, base, abs_tol=1e-6)
            assert -1e9 < r.score < 0
    assert language_model.language_model(empty).count() == 0


def test_words_with_equal_first_bytes_do_not_fill_a_part(spark, monkeypatch):
    r = random.Random(3)
    text = [" ".join([f"http{r.randrange(10**9)}" for _ in range(100)] + [f"{r.randrange(10**9)}" for _ in range(20)]) for _ in range(20)]
    rows = spark.createDataFrame([(t, True) for t in text], "text string, learn boolean")
    vocabulary = language_model.word_counts(rows, language_model.class_words(rows))
    scored = {h.pair: h.log10_p for h in language_model.word_scores(vocabulary).collect()}

    def rows_held(key, own, found):
        sizes = pa.array([float(len(own))] * len(own))
        return own.select(["pair", "hash", "class", "n", "total"]).append_column("log10_p", sizes)

    monkeypatch.setattr(language_model, "_add_up", rows_held)
    held = {h.pair: h.log10_p for h in language_model.word_scores(vocabulary).collect()}
    assert set(held) == set(scored) and len(held) == vocabulary.count() and all(p < 0 for p in scored.values())
    assert max(held.values()) < len(held) / 2


def test_context_trees_are_proper():
    """Over all bytes that may follow one context, the probabilities add up to one."""
    words = [b"the", b"then", b"tea", b"of"]
    data = np.frombuffer(b"".join(words), np.uint8)
    off = np.cumsum([0, *map(len, words)])
    code, _ = language_model.codes(data, off, np.zeros(4))
    code, n = np.unique(code, return_counts=True)
    context = code[-1] & ~np.uint64(255)
    every = np.unique(np.concatenate([code, context | np.arange(256, dtype=np.uint64)]))
    seen = np.zeros(len(every))
    seen[np.searchsorted(every, code)] = n * 50
    trees = language_model.Trees(every, seen)
    top = trees.top_nodes()
    p = np.exp(trees.log_probability(language_model.Top(*[np.asarray(top.column(k)) for k in range(5)])))
    assert math.isclose(p[(every & ~np.uint64(255)) == context].sum(), 1, rel_tol=1e-9)


@pytest.mark.parametrize("operator, label, mark", [(quality.quality, "quality", "*** ###"), (toxicity.toxicity, "toxic", "idiot scum")])
def test_classifiers_learn_and_stand_odd_rows(spark, docs, empty, operator, label, mark):
    from .conftest import passage

    bad = 0 if label == "quality" else 1
    good_rows = [(1000 + i, " ".join(passage(i, 30)), 1 - bad) for i in range(150)]
    bad_rows = [(2000 + i, " ".join(f"{w} {mark}" for w in passage(900 + i, 10)), bad) for i in range(150)]
    table = spark.createDataFrame(good_rows + bad_rows, f"doc_id long, text string, {label} int")
    both = docs.select("doc_id", "text").unionByName(table.select("doc_id", "text"))
    got = operator(both, table.select("doc_id", label)).collect()
    assert len(got) == docs.count() + 300 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in good_rows + bad_rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert operator(empty, table.select("doc_id", label)).count() == 0
    assert {r.score for r in operator(docs, table.select("doc_id", label).limit(0)).collect()} == {0.5}
