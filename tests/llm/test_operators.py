"""Each operator against brute force or an exact round trip on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invigil.llm import bpe, chat, fingerprints, language, near, packing, pii, sharding, substrings, topk
from invigil.session import tune


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    parts = ["an", "the", "ti", "on", "er", "re", "st", "in", "ou", "wh", "é", "ing"]
    return " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(n))


# -- op1 ---------------------------------------------------------------------------------


def search(llm, rows, **options):
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = topk.top_k(df, F.col("vec_id") % 5 == 0, **options).collect()
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in found}


def best(rows, k=5):
    vectors = [(i, [int(math.floor(256 * float(x))) for x in np.array(v, np.float32)]) for i, v in rows]
    out = set()
    for i, q in vectors:
        if i % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in vectors if j != i)
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])}
    return out


def test_top_k_is_exact(llm, monkeypatch):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rnd.normal(size=12) * 0.2).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)]  # ties
    assert search(llm, rows) == best(rows)
    monkeypatch.setattr(topk, "PACK", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "CELL", 20_000)
    monkeypatch.setattr(topk, "ASKED", 1_000)
    assert search(llm, rows) == best(rows)


@pytest.mark.parametrize("bits", [15, 23, 31, 40])
def test_large_components_are_exact(llm, bits):
    """Sums pass 2^53 from 2^23 on, and components 31 bits from there on, too."""
    rnd = np.random.default_rng(bits)
    rows = [(i, [float(x) for x in rnd.integers(-(2**10), 2**10, 3)] + [2.0 ** (bits - 8 if bits < 31 else 0)]) for i in range(120)]
    rows += [(201, [1.0, 2.0 ** (bits - 8)]), (202, [1.0, 2.0 ** (bits - 8)]), (207, [2.0 ** (bits - 8)] * 2)]
    assert search(llm, rows) == best(rows)


def test_scores_beyond_64_bits_are_the_largest(llm):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 2.0]), (2, [-(2.0**40), 0.0]), (3, [1e30, 0.0]), (4, [1.0])]
    found = sorted((r[1], r[2], r[3]) for r in search(llm, rows))
    assert found == [(1, 1, 2**63 - 1), (2, 3, 2**63 - 1), (3, 4, 2**56), (4, 2, 1 - 2**63)]


def test_scores_that_differ_in_the_last_bit_are_told_apart():
    query = topk.Search(np.array([0]), np.array([[2**30, 3]]), 2)
    query.visit(np.array([1, 2]), np.array([[2**30, 1], [2**30, 2]]))
    assert query.found.tolist() == [[2, 1]] and query.scores.tolist() == [[2**60 + 6, 2**60 + 3]]
    large = topk.Search(np.array([0]), np.array([[1e200, 3.0]]), 2)
    large.visit(np.array([1, 2]), np.array([[1e200, 1.0], [-1e200, 2.0]]))
    assert large.found.tolist() == [[1, 2]] and large.scores.tolist() == [[2**63 - 1, 1 - 2**63]]


def test_top_k_prunes_blocks_of_like_vectors():
    rnd = np.random.default_rng(2)
    vectors = np.concatenate([rnd.integers(-9, 9, (640, 16)), rnd.integers(200, 256, (64, 16))]).astype(np.int32)
    rows = np.concatenate(topk._halved(vectors, np.arange(len(vectors))))
    query = topk.Search(np.array([-1]), np.full((1, 16), 200, np.int32), 5)
    query.visit(rows.astype(np.int64), vectors[rows])
    assert query.blocks_scored < query.blocks_seen / 2


def test_top_k_of_odd_vectors(llm):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, []), (5, [0.5]), (6, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
    good = [(i, v) for i, v in rows if i in (0, 4, 5, 6)]
    assert search(llm, rows) == best(good)
    assert search(llm, [(0, [1.0])]) == set() == search(llm, [(1, [1.0]), (2, [1.0])])
    assert topk.top_k(llm.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    huge = [(0, [1e30, 1.0]), (1, [1e30, 2.0])]
    assert {r[2] for r in search(llm, huge)} == {1}


# -- op2 ---------------------------------------------------------------------------------


def spelled(same_length, vocabulary, table):
    """Sum over all segmentations, listed one by one."""

    def ways(word):
        if not word:
            return 1.0
        total = 0.0
        for end in range(1, len(word) + 1):
            if word[:end] in vocabulary:
                total += table[vocabulary[word[:end]]] * ways(word[end:])
        return total

    return [ways(w) for w in same_length]


def test_forward_sums_all_segmentations():
    vocabulary = {p: i for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca"])}
    table = np.array([[0.2, 0.1], [0.1, 0.1], [0.1, 0.3], [0.2, 0.1], [0.2, 0.1], [0.1, 0.1], [0.1, 0.2], [0, 0], [1e-7, 1e-7]])
    words = ["abcab", "caabc", "bbbbb"]
    for column in range(2):
        expected = np.log(spelled(words, vocabulary, table[:, column]))
        assert np.allclose(language.forward(words, vocabulary, table)[:, column], expected)
    long = language.forward(["abc" * 400], vocabulary, table)
    assert np.isfinite(long).all() and long[0, 0] < -100


def test_expected_uses_are_those_of_all_segmentations():
    vocabulary = {p: i for i, p in enumerate(["a", "b", "ab"])}
    table = np.array([0.5, 0.3, 0.2, 0.0, 1e-7])
    uses = language.expected(["ab"], np.array([2.0]), vocabulary, table)
    split, whole = 0.15, 0.2
    assert np.allclose(uses, [2 * split / 0.35, 2 * split / 0.35, 2 * whole / 0.35])


def test_languages_are_told_apart(llm):
    rnd = random.Random(3)
    stock = {"xx": ["thing", "with", "other", "house"], "yy": ["maison", "autre", "chose", "avec"]}
    rows = [(i, " ".join(rnd.choices(stock[lang], k=12)), lang) for i in range(60) for lang in [("xx", "yy")[i % 2]]]
    rows += [(100, None, "xx"), (101, "", None), (102, "123 !", "yy"), (103, "thing with house", None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.predictions(docs).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:60])
    assert [(found[i].lang_pred, found[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert found[103].lang_pred == "xx" and 0.5 < found[103].score <= 1
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert {r.doc_id for r in language.accepted(docs).collect()} == {*range(60), 103}


def test_predictions_do_not_read_labels(llm):
    rows = [(i, prose(i, 20), "xx" if i % 2 else "yy") for i in range(30)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    other = docs.withColumn("lang", F.when(F.col("doc_id").isin(held), "zz").otherwise(F.col("lang")))
    assert sorted(language.predictions(docs).collect()) == sorted(language.predictions(other).collect())


# -- op3 ---------------------------------------------------------------------------------


def test_edited_texts_and_likeness(table):
    rows = [(i * 700, "\n".join(prose(i * 50 + k, 12) + "." for k in range(i % 5 + 1))) for i in range(30)] + [(5, None), (6, ""), (7, "é"), (7, "é")]
    found = fingerprints.edits(table(rows)).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    expected = Counter()
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        expected[i, len(text), sha(text[: len(text) - half] + after[:half])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert len({r.fingerprint for r in found}) == len({t or "" for _, t in rows})


def test_next_documents_of_sparse_ids(table):
    """Ids that are hashes: every document is a block of its own, spread over all 64 bits."""
    rnd = random.Random(33)
    ids = [rnd.randrange(-(2**63), 2**63) for _ in range(300)] + [2**63 - 1, -(2**63), 0, -1]
    rows = [(i, f"text {n}") for n, i in enumerate(ids)]
    order = sorted(rows, reverse=True)
    found = {r.doc_id: r.next for r in fingerprints.with_next(table(rows)).collect()}
    assert found == {i: order[(n + 1) % len(order)][1] for n, (i, _) in enumerate(order)}
    plan = fingerprints._next_blocks(table(rows).select("doc_id"))._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(block#" in line]
    assert len(whole) <= 2  # over at most 2^12 rows


def test_fingerprint_ignores_order_and_takes_insertions(llm, table):
    a, b, c = "One thing.", "Another thing.", "A third."
    rows = [(1, f"{a}\n{b}"), (2, f"{b} {a}"), (3, f"{a}\n{b}\n{c}"), (4, c), (5, f"{a}\n{a}"), (6, a)]
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(table(rows)).collect()}
    assert prints[1] == prints[2] != prints[3] and prints[5] != prints[6]
    df = fingerprints.with_vectors(table(rows), "text", "v").groupBy().pivot("doc_id", [1, 3, 4]).agg(F.first("v"))
    df = df.withColumn("sum", fingerprints.plus(F.col("1"), F.col("4"))).withColumn("less", fingerprints.plus(F.col("3"), F.col("4"), -1))
    assert df.select(fingerprints.as_text("sum"), fingerprints.as_text("less")).first()[:] == (prints[3], prints[1])


def test_likeness_follows_shared_sentences(table):
    own = [prose(k, 8) + "." for k in range(60)]
    rows = [(3, " ".join(own)), (2, " ".join(own[:30])), (1, " ".join(prose(900 + k, 8) + "." for k in range(60)))]
    near_next = {r.doc_id: r.near_next for r in fingerprints.edits(table(rows)).collect()}
    assert near_next[3] == pytest.approx(2**-0.5, abs=0.2) and near_next[2] < 0.3


# -- op4 ---------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plainly(text):
    def valid(kind, match):
        digits = [int(c) for c in match if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            odd = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            return 14 <= len(digits) <= 19 and (sum(digits[::-2]) + odd) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_are_those_of_the_patterns(table):
    rnd = random.Random(4)
    stock = ["1", "23", ".", "@", "a", "b.c", " ", "-", "+", "(", "4539 1488 0343 6467", "999", "%", "é", "\n", "10.0.0.1", "x@y.z", "+1 555 123 4567"]
    rows = [(i, "".join(rnd.choices(stock, k=rnd.randint(0, 40)))) for i in range(3000)] + [(-1, None)]
    for r in pii.spans(table(rows)).collect():
        base = plainly(dict(rows)[r.doc_id])
        assert r.base_sha256 == sha(pii.listed(base))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in PATTERNS)
        assert {pii.listed([s]) for s in base} <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("Mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("Mail jane dot doe at example dot org now", "email", "jane dot doe at example dot org"),
        ("Mail jоhn@exаmple.com now", "email", "jоhn@exаmple.com"),
        ("so john@exam​ple.com it is", "email", "john@exam​ple.com"),
        ("card ４５３９ １４８８ ０３４３ ６４６７ ok", "card", "４５３９ １４８８ ０３４３ ６４６７"),
        ("plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("Mail john (at) example dot com now", "email", "john (at) example dot com"),
        ("Mail john@example dot co dot uk now", "email", "john@example dot co dot uk"),
        ("host 192 dot 168 dot 1 dot 20 up", "ip", "192 dot 168 dot 1 dot 20"),
        ("host 192.168 punkt 1.20 up", "ip", "192.168 punkt 1.20"),
        ("call +49 30 one two 4567890 now", "phone", "+49 30 one two 4567890"),
        ("call plus 49 30 eins 234567 neun 1 now", "phone", "plus 49 30 eins 234567 neun 1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    assert (kind, text.index(source), text.index(source) + len(source)) in pii.find(text)[1]


@pytest.mark.parametrize("words", ["one two three", "eins, zwei, drei", "plus four five six", "cero-uno-dos"])
def test_spelled_runs_elsewhere_hide_no_phone(words):
    phones = ["plus 49 30 1234567", "Plus-44 20 7946 0958"]
    for text in [f"Call {phones[0]} now. He counted {words} and left; or {phones[1]}.", f"{words}; {phones[0]}, {phones[1]}"]:
        spans = {("phone", text.index(p), text.index(p) + len(p)) for p in phones}
        assert spans == set(pii.find(text)[1])
        assert all(p not in pii.redact(text, pii.find(text)[1]) for p in phones)


def test_prose_is_left_alone():
    for text in [
        "We met at noon. Then we left.",
        "one two, and at last. It was at example.com there",
        "naïve café über",
        "It rose from 1 point 2 to 3 point 4, or 5 + 2 one 3, at home dot and all.",
        "In 2020 one 5 and (at) noon dot, @ home, 1.2.3 dot 4.5",
    ]:
        assert pii.find(text) == ([], [])
    assert pii.redact("a@b.cd x", pii.find("a@b.cd x")[1]) == "<email> x"


def test_patterns_are_linear():
    for text in ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1(" * 60_000, "a at " * 40_000, "one " * 50_000, "a@" * 100_000]:
        pii.find(text)


# -- op5 ---------------------------------------------------------------------------------


def test_chat_comes_back_from_its_formatted_text(llm):
    marks = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<|", "<\\|", "\\", "\n", "user", "<", "|", "<|nl|>", "é", " "]
    rnd = random.Random(5)
    rows = []
    for c in range(120):
        for t in range(rnd.randint(1, 5)):
            role = rnd.choice(["user", "assistant", "system", "a\nb", "<|nl|>", "", None])
            rows.append((c, t, role, rnd.choice([None, "", *["".join(rnd.choices(marks, k=rnd.randint(1, 8)))] * 4])))
    rows += [(500, 0, "assistant", "b"), (500, 0, "assistant", "a"), (None, 1, "assistant", "x")]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = {r.conv_id: r for r in chat.digests(df).collect()}
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t, role or "", text or ""))
    assert set(found) == set(turns)
    for c, own in turns.items():
        own.sort()
        said = "".join(x for _, role, x in own if role == "assistant")
        r = found[c]
        assert r.identical and r.n_turns == len(own)
        assert r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(said), sha(said))


def test_only_what_conflicts_is_escaped(llm):
    rows = [(1, 0, "user", "plain < | \\"), (2, 0, "user", "a <|im_end|> b")]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = {r.conv_id: r.formatted for r in chat.formatted(df).collect()}
    assert texts[1] == "<|im_start|>user\nplain < | \\<|im_end|>\n"
    assert texts[2] == "<|im_start|>user\na <\\|im_end|> b<|im_end|>\n"


# -- op6 ---------------------------------------------------------------------------------

PARTS = [". ", "b, ", "c.,", "a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u200b", "\u2003", "\u3000", "'s", "'LL", "é", "e\u0301", "1", "²", "Ⅷ",
         "中", "😀", "<|endoftext|>", "<|startoftext|>", "<|end", "!!", "\x00", "ß", "İ", "Σ", "_", "-"]


def fuzz(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(0, 30))) for _ in range(n)]


def test_bpe_agrees_with_the_public_library(table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    rows = list(enumerate([*fuzz(6, 800), prose(1, 300), "", None, "a" * 5000]))
    for r in bpe.round_trips(table(rows)).collect():
        text = rows[r.doc_id][1] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(back))
    some = table(rows[:50])
    back = bpe.decode(bpe.encode(some)).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_merges_follow_rank_then_place():
    ranks, merged = {(1, 2): 0, (2, 1): 1, (3, 3): 2}, [3, 4, 5]
    assert bpe.merge([1, 2, 1, 2, 1], ranks, merged) == [5, 1]
    assert bpe.merge([2, 1, 1], ranks, merged) == [4, 1]
    assert bpe.merge([1], ranks, merged) == [1]


# -- op7 ---------------------------------------------------------------------------------


def shingled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def grouped(rows, percent):
    sets = [(i, shingled(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, o in sets[:k]:
            if s and o and 100 * len(s & o) >= percent * len(s | o):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def copies(seed: int, groups: int, size: int, words: int = 150) -> list[tuple[int, str]]:
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        base = prose(seed * 1000 + g, words).split()
        for c in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = f"w{rnd.random()}"
            rows.append((len(rows), " ".join(own)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("region", [512, 4])
def test_near_groups_are_those_of_all_pairs(table, percent, region):
    """Also where nearly every region is too full, so that prefixes deepen and parts are cut."""
    rows = copies(7, 12, 12) + [(1000 + i, prose(i, 60)) for i in range(40)] + [(2000, None), (2001, " "), (2002, "A b"), (2003, "a  B"), (2004, "a b c")]
    found = near.groups(table(rows), percent, region).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == grouped(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_group_of_copies_costs_few_pairs(table):
    """Three hundred near copies of one text: the pairs to confirm are a few per copy, not all."""
    rows = copies(8, 1, 300)
    known = near.profiles(table(rows)).withColumnRenamed("doc_id", "node")
    members = near.deepened(near._counted(near._members(known)), known).join(known.select(F.col("node").alias("_n"), "signature"), F.col("node") == F.col("_n")).drop("_n")
    pairs = near._in_runs(members, ["key", "part"], near._neighbours(64)).count()
    assert 299 <= pairs < 300 * 299 / 2 / 4


def test_neighbours_follow_the_rotation_of_their_tree():
    """Four members pair off by the hashes from the offset of tree 2 on, and otherwise by hash 0."""
    own = np.zeros((4, near.HASHES), np.uint8)
    own[:, 0] = [0, 1, 0, 1]
    own[:, 2 * near.PREFIX + 5] = [0, 0, 1, 1]
    for tree, expected in [(0, {(0, 2), (2, 1), (1, 3)}), (2, {(0, 1), (1, 2), (2, 3)})]:
        run = pa.record_batch(
            [pa.array([tree] * 4, pa.int32()), pa.array(range(4), pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())],
            names=["tree", "node", "signature"],
        )
        left, right = next(near._neighbours(0)(run))
        assert set(zip(left.tolist(), right.tolist())) == expected


def test_one_document_of_each_group_is_kept(table):
    rows = [(3, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (2, prose(2, 50)), (4, None), (None, "x"), (None, "x")]
    assert Counter(r.doc_id for r in near.kept(table(rows)).collect()) == Counter([1, 2, 4, None, None])


def test_cells_of_open_regions_bring_all_components_together_once(llm):
    """One stray beside 5,000 members costs a row each, not one per pair of parts; every pair of components still meets."""
    big = [(1, 0, n, 0) for n in range(5000)] + [(1, 0, 5000, 5000)]
    mixed = [(2, 3, n, n % 7 if n < 40 else 0) for n in range(90)]
    closed = [(3, 1, n, 0) for n in range(90)]
    rows = big + mixed + closed
    cells = near.open_cells(llm.createDataFrame(rows, "key long, tree int, node long, component long").repartition(3), 10)
    found = defaultdict(lambda: defaultdict(list))
    for r in cells.collect():
        found[r.key][r.i, r.j].append(r)
    assert set(found) == {1, 2}
    assert sum(map(len, found[1].values())) <= 5001 + 501
    met = Counter()
    for own in found[2].values():
        for n, x in enumerate(own):
            for y in own[:n]:
                # As ``closed`` compares: across the parts of a cell of two.
                if x.component != y.component and (x.i == x.j or x.part != y.part):
                    met[frozenset((x.node, y.node))] += 1
    of = {n: c for _, _, n, c in mixed}
    assert met == {frozenset((a, b)): 1 for a in of for b in of if of[a] != of[b]}


def test_one_id_on_two_texts_names_two_documents(table):
    """Near copies of forty texts, two texts under each id, so that an id alone names no class."""
    rnd = random.Random(9)
    rows = []
    for g, (_, text) in enumerate(copies(9, 40, 1, 80)):
        other = text.split()
        other[40] = "changed"
        rows += [(g // 2, text), (100 + rnd.randrange(20), " ".join(other)), (g // 2, text)]
    named = {(i, t) for i, t in rows}
    expected = grouped([((i, t), t) for i, t in sorted(named)], 80)
    found = near.groups(table(rows), 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter(
        (i, expected[i, t][0], expected[i, t][1][0]) for i, t in rows
    )
    left = [(r.doc_id, r.text) for r in near.kept(table(rows)).collect()]
    assert set(left) == {root for _, root in expected.values()} and len(left) == 40


def test_one_of_near_copies_under_one_id_is_kept(table):
    text = prose(3, 90)
    rows = [(1, text), (1, text + " more"), (2, text + " less"), (1, prose(4, 90)), (None, text), (None, text + " more")]
    left = near.kept(table(rows)).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "1", "None", "None"]
    assert len({r.text.split()[0] for r in left if r.doc_id == 1}) == 2


def test_components_of_a_chain(llm):
    n = 200
    order = random.Random(1).sample(range(n), n)
    links = llm.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "a long, b long")
    assert {r.component for r in near.components(links).collect()} == {0}


# -- op8 ---------------------------------------------------------------------------------


def test_pieces_hold_the_library_s_ids_without_gaps(table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = list(enumerate([*fuzz(9, 200), prose(1, 3000), "", None, prose(2, 30), prose(2, 30)]))
    found = packing.pack(table(rows)).collect()
    places = defaultdict(list)
    for r in found:
        ids = [*tokenizer.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids, 0]
        own = ids[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(own) == r.length == min(2048, len(ids) - r.start)
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len({(r.doc_id, r.piece) for r in found}) == len(found)


def fewest(sizes: list[int], capacity: int) -> int:
    """By trying everything."""
    best = [len(sizes)]

    def put(i, rests):
        if len(rests) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rests)
            return
        for r in {x for x in rests if x >= sizes[i]}:
            k = rests.index(r)
            put(i + 1, [*rests[:k], r - sizes[i], *rests[k + 1 :]])
        put(i + 1, [*rests, capacity - sizes[i]])

    put(0, [])
    return best[0]


def test_reduction_fixes_only_what_an_optimum_has():
    rnd = random.Random(10)
    for _ in range(300):
        capacity = rnd.randint(8, 30)
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
        counts = packing.Counts(Counter(sizes))
        fixed = packing.reduce(counts, capacity)
        rest = [s for s, n in counts.of.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(sorted(rest, reverse=True), capacity) == fewest(sizes, capacity)
        whole = packing.pack_histogram(Counter(sizes), capacity)
        held = Counter()
        for content, n in whole:
            assert sum(s * q for s, q in content) <= capacity
            for s, q in content:
                held[s] += q * n
        assert held == Counter(sizes)


def test_packing_of_any_size_costs_the_same():
    rnd = random.Random(11)
    histogram = Counter(rnd.randint(1, 2048) for _ in range(5000))
    many = {s: n * 10_000_000 for s, n in histogram.items()}
    patterns = packing.pack_histogram(many)
    assert len(packing.ranges(patterns)) < 12 * 2048
    lowest = -(-sum(s * n for s, n in many.items()) // 2048)
    assert lowest <= sum(n for _, n in patterns) <= 1.02 * lowest


# -- op9 ---------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 2000])
def test_shards_are_even_and_whole(table, bucket_bytes):
    rows = [(i, prose(i % 90, 20) if i % 7 else None) for i in range(203)] + [(5, "same"), (5, "same")]
    found = sharding.shards(table(rows), 8, 11, bucket_bytes).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in sharding.places(table(rows)).collect():
        assert r.law == "rows" and r.grown_shard is None


def test_shuffle_is_seeded_and_uniform(table):
    rows = [(i, f"t{i}") for i in range(400)]

    def order(seed, partitions):
        found = sharding.shards(table(rows, partitions), 1, seed, 1 << 20).collect()
        return [r.doc_id for r in sorted(found, key=lambda r: r.slot)]

    first = order(11, 3)
    assert first == order(11, 5) != order(12, 3) and first != sorted(first)
    moved = np.array([order(s, 2) for s in range(20, 26)])
    assert abs(np.corrcoef(moved[0], moved[1])[0, 1]) < 0.25
    assert 100 < moved[:, :50].mean() < 300


# -- op10 --------------------------------------------------------------------------------


def covered_plainly(rows, length):
    counts = Counter()
    for _, t in rows:
        data = (t or "").encode()
        counts.update(data[p : p + length] for p in range(len(data) - length + 1))
    out = Counter()
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if counts[data[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i, len(data), sum(gone), runs, sha(kept)] += 1
    return out


def shared_passages(seed: int) -> list[tuple[int, str]]:
    rnd = random.Random(seed)
    passages = [prose(seed * 100 + k, rnd.randint(10, 70)) for k in range(12)]
    rows = []
    for i in range(70):
        parts = []
        for k in range(rnd.randint(1, 5)):
            parts.append(prose(seed * 10_000 + i * 10 + k, rnd.randint(1, 30)))
            if rnd.random() < 0.7:
                own = rnd.choice(passages)
                cut = rnd.randint(0, len(own) // 3)
                parts.append(own[cut : len(own) - rnd.randint(0, len(own) // 3)])
        rows.append((i, " ".join(parts)))
    return rows + [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (300, "ab" * 300), (301, "x" * 500), (302, None), (303, ""), (None, rows[1][1])]


@pytest.mark.parametrize(("length", "full"), [(100, 1000), (100, 1), (60, 5), (41, 1000)])
def test_repeated_bytes_are_those_of_all_windows(table, length, full, monkeypatch):
    """Also where classes count as full, and where texts are read in short stretches."""
    rows = shared_passages(length + full)
    if full == 5:
        monkeypatch.setattr(substrings, "PAIRWISE", 2)
    found = substrings.deduplicated(table(rows), length, full).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == covered_plainly(rows, length)


def test_texts_go_to_the_language_model_once(table):
    """The batch that a worker gets holds each text once, not in the row and beside it."""
    found = language.identify(table([(1, "a text"), (2, None)]), {}, names=("found", "likely"))
    plan = found._jdf.queryExecution().analyzed().toString()
    inner = next(line for line in plan.splitlines() if "struct(" in line)
    assert inner.count("text#") == 1, inner
    assert sorted((r.doc_id, r.text, r.found) for r in found.collect()) == [(1, "a text", "und"), (2, None, "und")]


def test_a_crowded_passage_makes_few_rows(table, monkeypatch):
    """Many documents share a passage between other texts: their windows are packed, not one row each."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    rows = [(i, "".join(rng.choices("stuvwxyz ", k=rng.randint(90, 300))) + passage[i % 7 :] + "".join(rng.choices("stuvwxyz ", k=99))) for i in range(300)]
    staged, stage = {}, substrings.stage
    monkeypatch.setattr(substrings, "stage", lambda df, purpose: staged.setdefault(purpose, stage(df, purpose)))
    found = substrings.deduplicated(table(rows), 80, 20).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == covered_plainly(rows, 80)
    suffixes = staged["suffixes"]
    assert staged["full-classes"].count() > 0 and suffixes.where("kind = 1").count() > 0
    assert suffixes.count() < 20 * len(rows)  # some 180 windows each


def test_windows_that_are_there_twice():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        window, check, known = rng.integers(0, 20, n), rng.integers(0, 3, n), rng.random(n) < 0.1
        repeated, first = substrings.twice(window, check, known)
        pairs = list(zip(window.tolist(), check.tolist()))
        sure = {p for p, k in zip(pairs, known) if k}
        assert repeated.tolist() == [pairs.count(p) > 1 or p in sure for p in pairs]
        assert sorted(p for p, f in zip(pairs, first) if f) == sorted(set(pairs))
        spans = list(zip(*(c.tolist() for c in substrings.ranges(window, check, np.arange(n)))))
        again = [(w, c, d) for w, c, low, high in spans for d in range(low, high + 1)]
        assert sorted(again) == sorted(zip(window.tolist(), check.tolist(), range(n)))


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    data = prose(1, 900).encode() + b"a" * 700
    whole = substrings.anchors(data, 100)
    monkeypatch.setattr(substrings, "STRETCH", 333)
    parts = substrings.anchors(data, 100)
    windows = lambda found: {(a, d) for a, near_, far, *_ in zip(*found) for d in range(near_, far + 1)}
    assert windows(whole) == windows(parts) and len(windows(whole)) == len(data) - 99


def test_every_window_has_one_anchor_and_equal_windows_the_same():
    data = (prose(2, 200) + " " + prose(3, 40) + " " + prose(2, 200)).encode()
    of = {}
    for at, near_, far, *_ in zip(*substrings.anchors(data, 80)):
        for d in range(near_, far + 1):
            window = data[at - d : at - d + 80]
            assert of.setdefault(window, d) == d


def test_loser_tree_merges_runs_with_their_common_prefixes():
    rnd = random.Random(12)
    for _ in range(60):
        runs, every = [], []
        for _ in range(rnd.randint(1, 9)):
            own = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 12))) for _ in range(rnd.randint(1, 12))]
            every += own
            runs.append(substrings.Run(substrings.front_coded([(s, b"", 0, 0, 1, 0, 0) for s in own])))
        out = list(substrings.merged(runs))
        assert [s for s, _, _ in out] == sorted(every)
        last = b""
        for s, shared, _ in out:
            assert shared == substrings.common_prefix(last, s)
            last = s


def test_cutting_leaves_whole_characters(table):
    passage = "é" * 80
    rows = [(1, "a" + passage + "b"), (2, "ü" + passage + "ö"), (3, "plain"), (4, None)]
    found = {r.doc_id: r.text for r in substrings.cut(table(rows), 61).collect()}
    assert found == {1: "ab", 2: "üö", 3: "plain", 4: None}


def test_cutting_moves_a_text_once(table, crowded, monkeypatch):
    seen, with_spans = [], substrings._with_spans
    monkeypatch.setattr(substrings, "_with_spans", lambda *a, **b: seen.append(with_spans(*a, **b)) or seen[-1])
    passage = "a passage of some length that comes twice, "
    docs = crowded(table([(1, "one " + passage + "two"), (2, "three " + passage + "four"), (3, None)]))
    out = substrings.cut(docs, 40)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    before, after = ({r.doc_id: r.asDict() for r in df.collect()} for df in (docs, out))
    texts = {i: r.pop("text") for i, r in after.items()}
    assert all(passage[1:-1] not in (t or "") for t in texts.values())
    assert texts == {1: "ontwo", 2: "threfour", 3: None}
    assert after == {i: {k: v for k, v in r.items() if k != "text"} for i, r in before.items()}
    moved = [f.name for df in seen for f in df.schema] + [g.name for df in seen for f in df.schema for g in getattr(f.dataType, "fields", [])]
    assert moved.count("text") == 1


def test_batches_for_workers_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    texts = tune(spark).range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 6000 * 4000 and max(found) < 10 << 20


# -- shapes ------------------------------------------------------------------------------


def test_native_operators_run_no_python(llm, table):
    turns = llm.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (fingerprints.edits(table([(1, "a"), (2, "b")])), chat.digests(turns), sharding.places(table([(1, "a")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_schemas_are_those_of_the_contract(llm, table):
    docs = table([(1, "a b")]).withColumn("lang", F.lit("en"))
    kinds = {T.LongType(): "long", T.StringType(): "string", T.DoubleType(): "double", T.BooleanType(): "boolean", T.IntegerType(): "int"}
    got = {
        2: language.predictions(docs), 3: fingerprints.edits(docs), 4: pii.spans(docs), 6: bpe.round_trips(docs),
        7: near.groups(docs), 8: packing.pack(docs), 9: sharding.places(docs), 10: substrings.deduplicated(docs),
    }
    expected = {
        2: "doc_id:long held_out:boolean lang_pred:string score:double",
        3: "doc_id:long n_chars:long edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
        4: "doc_id:long n_email:long n_ip:long n_card:long n_phone:long base_sha256:string spans:string",
        6: "doc_id:long n_tokens:long ids_sha256:string decoded_sha256:string",
        7: "doc_id:long n_shingles:long component_id:long kept:boolean",
        8: "doc_id:long piece:long start:long length:long ids_crc32:long sequence_id:long offset:long",
        9: "doc_id:long size:long text_crc32:long law:string shard:int slot:long grown_shard:int",
        10: "doc_id:long n_bytes:long n_removed:long n_spans:long kept_sha256:string",
    }
    for n, df in got.items():
        columns = [f"{f.name}:{kinds.get(f.dataType)}" for f in df.schema]
        assert columns[: len(expected[n].split())] == expected[n].split(), n
