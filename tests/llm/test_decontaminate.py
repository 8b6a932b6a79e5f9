import random
import re
import string

import pyarrow as pa

from kindred.llm import decontaminate as D
from kindred.llm import kernels
from tests.llm.cases import awkward, none

ITEM = "In the old market Anna bought 12 apples for 30 dollars and later that day Anna sold 5 of the apples to her friend Bruno for 20 dollars each."
OTHER_VALUES = ITEM.replace("Anna", "Maria").replace("12 apples", "44 apples").replace("30", "70").replace("Bruno", "Tom").replace("for 20", "for 90")
MIXED_NAMES = "In the old market Anna bought 12 apples for 30 dollars and later that day Clara sold 5 of the apples to her friend Bruno for 20 dollars each."
CLEAN = "Several people walked along the quiet river in the evening and talked about the weather of the past week."


def tables(spark):
    pad = "some words before it all begins here"
    docs = [(1, ITEM), (2, f"{pad} {OTHER_VALUES} {pad}"), (3, MIXED_NAMES.replace("12", "99").replace("Anna", "Dora").replace("Clara", "Eva")), (4, CLEAN), (5, None), (6, ""), (7, ITEM[: len(ITEM) // 2])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, ITEM), (11, None), (12, "too short")], "item_id long, text string")


def test_template():
    texts = ["Give Anna 5 kg of it. Then 3 cats left Élodie", "", None, "12"]
    data, at = kernels.buffer(pa.array(texts))
    t = D.Template(data, at)
    assert t.kind[t.row == 0].tolist() == [D.LITERAL, D.NAME, D.NUMBER, D.UNIT, D.LITERAL, D.LITERAL, D.LITERAL, D.NUMBER, D.LITERAL, D.LITERAL, D.NAME]
    assert t.kind[t.row == 3].tolist() == [D.NUMBER]


def test_slots(spark):
    docs, items = tables(spark)
    for most in (D.MOST_BROADCAST, 0):  # by broadcast, and by a shuffled join
        found = {r["doc_id"]: r for r in D.contaminated(docs, items, most_broadcast=most).collect()}
        assert set(found) == {1, 2, 7}
        assert not found[1]["reparameterised"] and found[2]["reparameterised"] and found[1]["coverage"] == 1
    assert {r["doc_id"] for r in D.keep(docs, items).collect()} == {3, 4, 5, 6}


def test_conflicting_slots(spark):
    """A conflict takes out the windows that hold it, not the alignment; numbers may coincide and split."""
    words = [f"w{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(60)]
    words[10] = words[40] = "Anna"
    changed = [*words[:40], "Clara", *words[41:]]
    fruit = "then sam has 3 apples and 4 pears and wants to know how many pieces of fruit he has in all"
    equal = "on the shelf stood 3 red jars and 3 blue jars and nobody knew what was kept in any of them"
    items = spark.createDataFrame([(1, " ".join(words)), (2, fruit), (3, equal)], "item_id long, text string")
    docs = [(1, " ".join(changed)), (2, fruit.replace("3", "5").replace("4", "5")), (3, equal.replace("3 red", "5 red").replace("3 blue", "7 blue")), (4, MIXED_NAMES), (5, CLEAN)]
    found = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 3)}
    assert found[1, 1]["n_windows"] == 45 and not found[1, 1]["reparameterised"]
    assert found[2, 2]["reparameterised"] and found[3, 3]["reparameterised"]


def test_part_of_a_long_item(spark):
    words = [f"word{i}" for i in range(90)]
    docs = spark.createDataFrame([(1, "before " + " ".join(words[30:43]) + " after"), (2, "before " + " ".join(words[30:41]) + " after")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words).replace("word", "alpha").translate(str.maketrans("0123456789", "abcdefghij")))], "item_id long, text string")
    docs = docs.selectExpr("doc_id", "translate(replace(text, 'word', 'alpha'), '0123456789', 'abcdefghij') AS text")
    assert [r["doc_id"] for r in D.contaminated(docs, items).collect()] == [1]


def test_short_item(spark):
    docs = spark.createDataFrame([(1, "so what is the capital of norway today"), (2, CLEAN)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "what is the capital of norway")], "item_id long, text string")
    assert [r["doc_id"] for r in D.contaminated(docs, items).collect()] == [1]


def test_items_of_few_literals(spark, caplog):
    """Items that templates can't tell are found where a document holds them; those without a word are reported."""
    texts = ["12 + 7 * 3 - 4 = 29", "Anna Bruno Clara Dora Emil Frida Gustav Hanna Igor Julia", "THE RED HOUSE STANDS BY THE OLD BRIDGE OF THE TOWN", "世界上最高的山峰是哪一座", "der Hund jagt die Katze und der Vogel sieht dem Fisch im Teich zu"]
    items = spark.createDataFrame([*enumerate(texts), (90, "?! ..."), (91, None)], "item_id long, text string")
    held = [f"some words before {x} and some after" for x in texts[:3]] + ["我想知道世界上最高的山峰是哪一座。谢谢", texts[4].lower()]
    docs = spark.createDataFrame([*enumerate(held), (50, CLEAN), (51, "12 + 7 * 3 - 5 = 28"), (52, "世界上有很多山")], "doc_id long, text string")
    for most in (D.MOST_BROADCAST, 0):
        found = D.contaminated(docs, items, most_broadcast=most).collect()
        assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in found} == {(i, i, 1.0) for i in range(5)}
    assert {r["item_id"] for r in D.without_windows(items).collect()} == {90, 91}
    assert "2 benchmark items" in caplog.text


def test_spaced():
    texts = ["ab漢字c", "漢", "", "字", "é naïve \u201cx\u201d", "ไทย𠀀"]
    data, at = D.spaced(*kernels.buffer(pa.array(texts)))
    rows = [bytes(data[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [r.split() for r in rows] == [["ab", "漢", "字", "c"], ["漢"], [], ["字"], ["é", "naïve", "\u201cx\u201d"], ["ไ", "ท", "ย", "𠀀"]]


def test_verbatim_items(spark, sf_dir):
    """Every document that has an item's words in a row is found, and no other."""
    from kindred.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in d["text"]}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, sf_dir).collect()} == want


def test_awkward_and_empty(spark):
    docs, items = awkward(spark), tables(spark)[1]
    assert D.keep(docs, items).count() == docs.count() and D.keep(docs, items).columns == docs.columns
    assert D.contaminated(docs, items.filter("false")).count() == 0
    assert D.contaminated(none(spark), items).count() == 0
    copies = spark.createDataFrame([(1, ITEM)] * 3 + [(None, ITEM)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in D.contaminated(copies, items).collect()) == [0, 1]
    assert D.keep(copies, items).count() == 0


def tokens_of(text):
    """Template tokens by plain Python: (code, slot value or None, kind, first word), and bare words."""
    words, kinds, joins = [], [], []
    opens = True
    gap = True
    for raw in re.findall(r"\S+|\n", text or ""):
        if raw == "\n":
            opens = True
            continue
        core = raw.strip(string.punctuation)
        if core:
            first = core[0]
            kind = "number" if first.isdigit() else "name" if first.isupper() and not (opens and core.lower() in D.OPENERS) else "literal"
            if kind == "literal" and kinds and kinds[-1] == "number" and core.lower() in D.UNITS:
                kind = "unit"
            joins.append(not (gap or opens or not raw.startswith(core)))
            words.append(core.lower())
            kinds.append(kind)
        gap = not (core and raw.endswith(core))
        tail = raw[raw.rindex(core) + len(core) :] if core else raw
        opens = any(c in tail for c in ".!?:")
    out = []
    for i, (w, k) in enumerate(zip(words, kinds, strict=True)):
        if k == "name" and out and out[-1][2] == "name" and joins[i]:
            out[-1] = (out[-1][0], out[-1][1] + " " + w, "name", out[-1][3])
        else:
            out.append((w if k == "literal" else f"<{k}>", None if k == "literal" else w, k, i))
    return out, words


def brute(docs, items, width=8):
    """(document, item) by all windows of all pairs."""
    hits = set()
    for d, text in docs:
        dt, dw = tokens_of(text)
        for b, item in items:
            it, iw = tokens_of(item)
            if not iw:
                continue
            places, typed_all, found = set(), set(), {}
            for typed, own, other in ((True, it, dt), (False, iw, dw)):
                w = min(width, len(own))
                code = lambda x, typed=typed: x[0] if typed else x
                index = {}
                for i in range(len(own) - w + 1):
                    part = own[i : i + w]
                    if typed and sum(x[2] == "literal" for x in part) < D.LITERALS:
                        continue
                    place = own[i][3] if typed else i
                    places.add(place)
                    if typed:
                        typed_all.add(place)
                    start = i if typed else max(k for k, x in enumerate(it) if x[3] <= i)
                    index.setdefault(tuple(map(code, part)), []).append((i, start, place))
                for j in range(len(other) - w + 1):
                    for i, start, place in index.get(tuple(map(code, other[j : j + w])), []):
                        pos = j if typed else max(k for k, x in enumerate(dt) if x[3] <= j)
                        pairs = frozenset((own[i + k][2], own[i + k][1], other[j + k][1]) for k in range(w) if own[i + k][1] is not None) if typed else frozenset()
                        found.setdefault(pos - start, set()).add((place, typed, pairs))
            left = set()
            for windows in found.values():
                fixed = {p for _, _, ps in windows for p in ps if p[0] != "number"}
                clash = {p for p in fixed if any(((p[:2] == q[:2]) != ((p[0], p[2]) == (q[0], q[2]))) for q in fixed)}
                same = lambda ps: all(a == b for _, a, b in ps)
                good = {x for x in windows if same(x[2]) or not (x[2] & clash)}
                if clash:
                    verbatim = {x[0] for x in good if same(x[2])}
                    row = any(all(p + k in verbatim for k in range(D.ENOUGH + 1)) for p in verbatim)
                    if not row and not 2 * len({x[0] for x in good}) > len({x[0] for x in windows}):
                        continue
                left |= good
            n, n_typed = {x[0] for x in left}, {x[0] for x in left if x[1]}
            share = max(len(n) / len(places), len(n_typed) / len(typed_all) if typed_all else 0)
            if left and (share >= D.COVERAGE or len(n) >= D.ENOUGH):
                hits.add((d, b, len(n), len(places)))
    return hits


NAMES = ["Mary Ann Brown", "John Paul Smith", "Zoe", "Max", "Ida Lund", "Ömer", "Ольга"]


def problem(rng, names, literals):
    a, b = names
    n = [rng.randint(2, 99) for _ in range(3)]
    unit = rng.choice(["apples", "kg", "dollars"])
    return literals.format(a=a, b=b, x=n[0], y=n[1], z=n[2], u=unit)


def fixture(seed=0):
    rng = random.Random(seed)
    plots = [
        "{a} has {x} {u} in the big cellar. Then {b} brings {y} more of them and {a} gives {z} of all these back to {b} on the next day.",
        "On the way to the market {a} met {b}, who carried {x} {u} and sold {y} of them for {z} dollars to some other traders there.",
        "Every week {a} walks {x} km while {b} walks {y} km along the same old river. How far do {a} and {b} walk in {z} weeks?",
        "What is the sum of {x} and {y} if {z} is taken away before it is doubled?",
    ]
    items = [(k, problem(rng, rng.sample(NAMES, 2), plots[k])) for k in range(4)]
    docs = []
    for i in range(60):
        k = rng.randrange(4)
        one, two = rng.sample(NAMES, 2)
        text = problem(rng, (one, rng.choice([one, two, two])), plots[k])
        words = text.split()
        cut = rng.choice([0, rng.randint(0, len(words) // 2)])
        text = " ".join(words[cut : rng.choice([len(words), rng.randint(cut + 4, len(words))])])
        docs.append((i, rng.choice(["", "Some words stand here.\n", "and then "]) + text + rng.choice(["", " and so on", ".\nNew line"])))
    docs += [(100 + k, t) for k, t in items] + [(200, CLEAN), (201, None), (202, "")]
    return docs, items


def test_against_brute_force(spark):
    """Names of other lengths, at the start of a sentence too, conflicting slots, cut texts; items that stand in several rows."""
    docs, items = fixture()
    want = brute(docs, items)
    assert {d for d, *_ in want} >= {100, 101, 102, 103} and 20 < len(want) < 64
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for rows, bounds in ((items, {}), (items * 3, {}), (items * 2, {"most_broadcast": 0, "most_keys": 0})):
        found = D.contaminated(frame, spark.createDataFrame(rows, "item_id long, text string"), **bounds).collect()
        assert {(r["doc_id"], r["item_id"], r["n_windows"], r["item_windows"]) for r in found} == want


def test_names_of_other_lengths(spark):
    item = "In spring Mary Ann Brown lent 12 books to John Paul Smith and in the autumn he gave 5 of them back to her."
    other = item.replace("Mary Ann Brown", "Zoe").replace("John Paul Smith", "Max").replace("12", "31")
    starts = "Zoe owns 7 green hats and buys 3 more each month for the whole of a long year."
    items = spark.createDataFrame([(1, item), (2, starts)], "item_id long, text string")
    docs = spark.createDataFrame([(1, other), (2, starts.replace("Zoe", "Mary Ann Brown").replace("7", "9")), (3, CLEAN)], "doc_id long, text string")
    found = D.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in found} == {(1, 1, True), (2, 2, True)}


def test_part_of_an_item_in_several_rows(spark):
    words = [f"w{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(23)]
    docs = spark.createDataFrame([(1, "so " + " ".join(words[:11]) + " it is")], "doc_id long, text string")
    for times in (1, 2, 5):
        items = spark.createDataFrame([(1, " ".join(words))] * times, "item_id long, text string")
        assert [(r["n_windows"], r["item_windows"]) for r in D.contaminated(docs, items).collect()] == [(4, 16)]
