"""Sentence pieces, the filter audit and the repair of conversations against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from invigil.llm import filter_audit, repair, sentence_pieces
from tests.llm.conftest import ODD


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- op11 --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.load(sentence_pieces.model_path())


def test_pieces_are_the_librarys(library, model):
    rnd = random.Random(11)
    for n in range(4000):
        text = "".join(rnd.choices("  abcdeétion\n\t▁0123xyz.,;梦😀\0ß́", k=rnd.randint(0, 60)))
        text = text + " " * rnd.randint(0, 40) if n % 3 else " " * rnd.randint(0, 40) + text
        ids = model.encode(text)
        assert ids == library.encode(text, add_eos=True)
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["x" * 30_000, " " * 30_001, "<s></s><0x0A><unk>", "é" * 9_000, "etaoinshrdlu" * 3_000])
def test_long_and_special_texts(library, model, text):
    assert model.encode(text) == library.encode(text, add_eos=True)
    assert model.encode(text, end=False) == library.encode(text)


def test_whole_texts_need_no_seams(library, model):
    """The walk over a whole text, not cut into parts, gives the same, over borders of blocks as well."""
    rnd = random.Random(12)
    text = " ".join("".join(rnd.choices("etaoinshrdlcumwf", k=rnd.randint(1, 14))) for _ in range(2_000))
    assert list(model.walk("▁" + text.replace(" ", "▁"))) == library.encode(text)


def test_failed_places_are_left_by_backtracking(model):
    """Some words need a shorter piece than the longest that fits."""
    rnd = random.Random(13)
    greedy_fails = 0
    for _ in range(2000):
        word = "▁" + "".join(rnd.choices("etaoinshr", k=12))
        longest, greedy, at = sentence_pieces.starts(model.automaton, word), [], 0
        while at < len(word):
            fits = [p for n in range(1, 17) if (p := word[at : at + n]) in model.ids and model.merged(p) == [p]]
            assert model.pieces[longest[at]] == max(fits, key=len)
            greedy.append(max(fits, key=len))
            at += len(greedy[-1])
        found = [model.pieces[i] for i in model.walk(word)]
        assert found == model.merged(word)
        greedy_fails += found != greedy
    assert greedy_fails > 100


def test_decoding_any_ids(library, model):
    rnd = random.Random(14)
    for _ in range(4000):
        ids = [rnd.choice([rnd.randrange(32_000), rnd.randrange(259), 259, 28705, rnd.randrange(3)]) for _ in range(rnd.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


def test_round_trips_of_odd_rows(library, table):
    found = Counter(tuple(r) for r in sentence_pieces.round_trips(table(ODD)).collect())
    expected = Counter()
    for doc_id, text in ODD:
        ids = library.encode(text or "", add_eos=True)
        expected[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert found == expected
    rows = sentence_pieces.decode(sentence_pieces.encode(table(ODD))).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in rows)


# -- op12 --------------------------------------------------------------------------------


def audited(rows, labels):
    """By the text of the task, one order and document at a time."""
    flags = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            good, bad = flags.get(doc_id, (False, False))
            flags[doc_id] = good or quality == 1, bad or toxic == 1
    texts = [t or "" for _, t, _ in rows]
    fails = []
    for (doc_id, _, _), text in zip(rows, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any(t == text and i is not None and i < doc_id for (i, _, _), t in zip(rows, texts))
        own = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search("[#$%&*|]", text)),
            copy,
        ]
        fails.append({letter for letter, bad in zip("ABCDE", own) if bad})
    out, shapley = {}, Counter()
    for part in {lang or "" for _, _, lang in rows}:
        members = [(fail, flags.get(i, (False, False))) for (i, _, lang), fail in zip(rows, fails) if (lang or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[0]]
                left = [m for m in left if letter not in m[0]]
                failing = sum(letter in m[0] for m in members)
                alone = sum(m[0] == {letter} for m in members)
                good, toxic = (sum(m[1][n] for m in gone) for n in (0, 1))
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), alone, good, toxic)
                shapley[part, letter] += len(gone)
    return {(*key, *found, shapley[key[0], key[1][key[2] - 1]]) for key, found in out.items()}


def test_filter_audit(llm):
    rnd = random.Random(21)
    rows = []
    for i in range(260):
        n = rnd.choice([0, 3, 199, 200, 201, 260])
        words = [rnd.choice(["same", "Same", f"w{k}", f"W{k}", "#x", "A"][: rnd.choice([1, 3, 6])] + [f"v{k}"]) for k in range(n)]
        rows.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice([" ", "\n", "  "]).join(words), rnd.choice(["en", "de", "", None])))
    rows += [(1000 - i, "copied " * 3, "en") for i in range(40)] + [(7, None, None), (None, "copied " * 3, "de")]
    rows += [rows[5], rows[5], (rows[5][0], rows[5][1], "de")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 1000, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    marks = llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, marks).collect()
    assert len(found) == 3 * 600
    assert {tuple(r) for r in found} == audited(rows, labels)
    crowded = docs.select("*", *[F.lit("x").alias(n) for n in ("mask", "part", "n", "good", "words", "digest", "first")])
    assert {tuple(r) for r in filter_audit.audit(crowded, marks.withColumn("good", F.lit("x"))).collect()} == {tuple(r) for r in found}


def test_filter_audit_of_no_rows(llm):
    docs = llm.createDataFrame([], "doc_id long, text string, lang string")
    marks = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, marks).collect() == []
    one = llm.createDataFrame([(None, None, None)], docs.schema)
    assert {(r.part, r.kept) for r in filter_audit.audit(one, marks).where("step = 5").collect()} == {("", 0)}


@pytest.mark.parametrize("size", range(1, 6))
def test_swaps_visit_every_order_once(size):
    order = list(range(size))
    seen = [tuple(order)]
    for change in filter_audit.plain_changes(size):
        order[change : change + 2] = order[change + 1], order[change]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(size)))


def test_diagrams_share_equal_parts():
    same = {mask: (5, 0, 0) for mask in range(32)}
    diagram = filter_audit.Diagram(same, 5)
    assert [len(level) for level in diagram.children] == [1] * 5
    diagram.swap(2)
    assert [len(level) for level in diagram.children] == [1] * 5 and diagram.order == [0, 1, 3, 2, 4]


# -- op13 --------------------------------------------------------------------------------

WORD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(kinds):
    """All edits of a few rows, listed one by one."""
    best = None

    def go(i, word, audit, cost, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(kinds) and WORD.match(word) and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserted < 2:
            for role in "ua":
                go(i, word + role, audit + "I", cost + 2, inserted + 1)
        if i < len(kinds):
            initial, goes, truncated = kinds[i]
            go(i + 1, word, audit + "D", cost + 3, 0)
            if not goes:
                go(i + 1, word + (initial or "x"), audit + "K", cost + truncated, 0)
                for role in "ua":
                    go(i + 1, word + role, audit + "R", cost + 2 + truncated, 0)

    go(0, "", "", 0, 0)
    return best


def kinds_of(rnd, n):
    out = []
    for _ in range(n):
        goes = rnd.random() < 0.2
        out.append((rnd.choice(["u", "a", "s", ""]), goes, not goes and rnd.random() < 0.3))
    return out


def every_cut(kinds):
    """A full chart: every span from every cut."""
    chart = {(i, i + 1): repair.leaf(k) for i, k in enumerate(kinds)}
    for size in range(2, len(kinds) + 1):
        for i in range(len(kinds) - size + 1):
            cell = chart[i, i + size] = {}
            for cut in range(i + 1, i + size):
                for z, found in repair.combine(chart[i, cut], chart[cut, i + size]).items():
                    cell[z] = min(found, cell.get(z, found))
    return min(chart[0, len(kinds)][z] for z in repair.COMPLETE if z in chart[0, len(kinds)])


def test_parse_is_the_cheapest_repair():
    rnd = random.Random(31)
    assert repair.parse([]) == (0, "")
    for _ in range(400):
        kinds = kinds_of(rnd, rnd.randint(1, 3))
        assert repair.parse(kinds) == cheapest(kinds) == every_cut(kinds)
    for _ in range(60):
        kinds = kinds_of(rnd, rnd.randint(5, 30))
        assert repair.parse(kinds) == every_cut(kinds)


def test_long_conversations_are_parsed():
    rnd = random.Random(32)
    cost, audit = repair.parse(kinds_of(rnd, 20_000))
    assert sum(audit.count(e) for e in "DKR") == 20_000 and cost > 0


def restored(rows):
    """One conversation's (turn, role, text) rows by the text of the task."""
    kept = []
    for turn, role, text in rows:
        kept.append((turn, role, text))
    seen, kinds, counts = set(), [], Counter()
    for _, role, text in kept:
        core = text.strip(" \t\n\v\f\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        kinds.append((role[:1] if role[:1] in ("u", "a", "s") else "", fault in ("blank", "duplicate"), fault == "truncated"))
    pairs = zip(kept, kept[1:])
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in pairs)
    turns = [t for t, _, _ in kept if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(kinds) if len(kinds) < 5 else every_cut(kinds)
    given, lines = iter(kept), []
    roles = "s" * ((len(audit) - audit.count("D")) % 2)
    for edit in audit:
        _, role, text = next(given) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        expected = roles[0] if roles and not lines else "ua"[(len(lines) - len(roles)) % 2]
        assert edit != "K" or role[:1] == expected
        lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[expected]}:{text}")
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines))


def damage(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        own = out.setdefault(conv_id, [])
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv_id: sorted(own, key=order) for conv_id, own in out.items()}


def conversations(rnd, n):
    rows = []
    for i in range(n):
        conv_id = rnd.choice([i, i, None]) if i % 9 == 0 else i
        for turn in range(rnd.randint(1, 5 if conv_id is not None else 1)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rnd.choice(["Hi.", "Hi.", "so what?", "cut off", "cut ", "", " \n", None, "wow!\t", "é.", "名。"])
            rows.append((conv_id, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    return [r for n, r in enumerate(rows) if r[0] is not None or sum(x[0] is None for x in rows[:n]) < 4]


def test_conversations_are_repaired(llm):
    rows = conversations(random.Random(33), 160)
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    crowded = df.select("*", *[F.lit("x").alias(n) for n in ("rows", "cost", "audit", "copies", "_fate")])
    found = repair.audit(repair.damaged(crowded)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {i: restored(own) for i, own in damage(rows).items()}
    assert len(found) == len({r[0] for r in rows})
    lines = {}
    for r in sorted(repair.repair(repair.damaged(df)).collect(), key=lambda r: r.turn):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(sha("\n".join(lines.get(r.conv_id, []))) == r.repaired_sha256 for r in found)
    undamaged = {r.conv_id: r.audit for r in repair.audit(df).collect()}
    whole = llm.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], df.schema)
    assert repair.audit(whole).first().audit == "KK" and len(undamaged) == len(found)


def test_repair_of_no_rows_and_dropped_rows(llm):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.audit(repair.damaged(llm.createDataFrame([], schema))).collect() == []
    assert repair.repair(llm.createDataFrame([], schema)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = repair.audit(repair.damaged(llm.createDataFrame([(gone, 0, "user", "Hi.")], schema))).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_a_large_conversation_is_repaired(llm):
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(5_000)]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    (found,) = repair.audit(df).collect()
    assert (found.cost, found.audit) == (0, "K" * 5_000)
    assert found.repaired_sha256 == sha("\n".join(f"{r}:{t}" for _, _, r, t in rows))


# -- memories and samples ----------------------------------------------------------------


def test_long_words_are_not_remembered():
    from invigil.llm import bpe, packing

    words = packing.Words(packing.vocabulary_path())
    texts = ["short " + "y" * 200, "z" * 300 + ". other", "y" * 200]
    assert words.ids(texts) == packing.Words(packing.vocabulary_path()).ids(texts)
    assert all(len(w) <= packing.SHORT for w in words.known) and b"short" in words.known
    encoder = bpe.load(bpe.vocabulary_path())
    encoder.encode("a" * 5_000 + " short")
    assert all(len(w) <= encoder.known.longest for w in encoder.known) and " short" in encoder.known


def test_samples_are_the_first_of_each_language(llm, monkeypatch):
    from invigil.llm import language

    monkeypatch.setattr(language, "PARTS", 4)
    rnd = random.Random(41)
    rows = [(rnd.choice(["en", "en", "en", "de", "fr"]), rnd.randrange(-500, 500)) for _ in range(900)]
    df = llm.createDataFrame(rows, "lang string, _order long").repartition(3)
    found = df.where(language._among_first(df, 40, F.col("lang"), F.col("_order"))).collect()
    expected = Counter()
    for lang in {r[0] for r in rows}:
        own = sorted(o for x, o in rows if x == lang)
        expected.update((lang, o) for o in own if o <= own[min(40, len(own)) - 1])
    assert Counter(tuple(r) for r in found) == expected
