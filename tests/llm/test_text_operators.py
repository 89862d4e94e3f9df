"""Text operators: packing rules, leakage against brute force, sentence offsets."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm.leakage import banded_distance, build_index, find, gram_hashes, leaks, words
from depweave.llm.packing import length_buckets, pack, plan
from depweave.llm.sentences import sentence_offsets, sentences


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Yes. mizzen does. No. 5 is it. No. Then go.", ["Yes.", "mizzen does.", "No. 5 is it.", "No.", "Then go."]),
        ('He asked, "Why is a/b.ts so?" Owners, e.g. A or B, may.', ['He asked, "Why is a/b.ts so?"', "Owners, e.g. A or B, may."]),
        ('The log said "It failed. Retry." and went on. "Stop!" was all.', ['The log said "It failed. Retry." and went on.', '"Stop!" was all.']),
        ("The slice (it was so at the time!) lives. (It is tracked.) What!!!", ["The slice (it was so at the time!) lives.", "(It is tracked.)", "What!!!"]),
        ("At 9 a.m. CI ran. It ends at 6 p.m. Nobody came.", ["At 9 a.m. CI ran.", "It ends at 6 p.m.", "Nobody came."]),
        ("We skip tmp, etc. ab-c resolves. Folders etc. are out. Skip etc. 16 were left. (It is so.) ab does.", ["We skip tmp, etc.", "ab-c resolves.", "Folders etc. are out.", "Skip etc.", "16 were left.", "(It is so.)", "ab does."]),
        ("It was so... then it went. Hm… yes.", ["It was so... then it went.", "Hm… yes."]),
        ("Am 28. Mai ist z. B. Ruhe. Siehe Nr. 3 bzw. S. 4 usw. im Text.", ["Am 28. Mai ist z. B. Ruhe.", "Siehe Nr. 3 bzw. S. 4 usw. im Text."]),
        ("Es heißt: „Es ging schief. Bitte neu.“ und dann nichts. Er fragte: „Wer?“ Im Plan", ["Es heißt: „Es ging schief. Bitte neu.“ und dann nichts.", "Er fragte: „Wer?“", "Im Plan"]),
        ("« Stop ! » disait-on. C'est p. ex. ici, c.-à-d. là.", ["« Stop ! » disait-on.", "C'est p. ex. ici, c.-à-d. là."]),
        ("¡Alto!, dijo. ¿Por qué? No. Acaba a las 6 p. m. Nadie vino.", ["¡Alto!, dijo.", "¿Por qué?", "No.", "Acaba a las 6 p. m.", "Nadie vino."]),
        ("Это ок. 5 штук, в т. ч. одна. И т. д. при запуске. «Стоп!» — сказал он.", ["Это ок. 5 штук, в т. ч. одна.", "И т. д. при запуске.", "«Стоп!» — сказал он."]),
        ("评审问：“谁需要a/b.ts？”通过了。日志写着“失败了。再试。”然后停了。它很……是的。", ["评审问：“谁需要a/b.ts？”", "通过了。", "日志写着“失败了。再试。”然后停了。", "它很……", "是的。"]),
        ("「止めて！」とあった。古いです…。『本。第二版』に。", ["「止めて！」とあった。", "古いです…。", "『本。第二版』に。"]),
        ("डॉ. नियम है। यह \"विफल। फिर।\" और बस। मत!", ["डॉ. नियम है।", "यह \"विफल। फिर।\" और बस।", "मत!"]),
        ("كتب «فشلت x. أعد.» ثم توقف. لماذا؟ لا.", ["كتب «فشلت x. أعد.» ثم توقف.", "لماذا؟", "لا."]),
        ("ผ่านแล้ว ไม่ต้อง รุ่น5.2.1แก้แล้ว", ["ผ่านแล้ว", "ไม่ต้อง", "รุ่น5.2.1แก้แล้ว"]),
        ("# Head\n\n- one. two\n- three\n\n1. a\n2. b c\n", ["Head", "one.", "two", "three", "a", "b c"]),
        ("> a b\n> c. d\n\nsee line\n22. Next", ["a b\n> c.", "d", "see line\n22.", "Next"]),
        ("x.\r\n\r\ny\r\nz", ["x.", "y\r\nz"]),
        ("```\na. b\n```\nc. d", ["c.", "d"]),
        ("a ) b. c ( d. e", ["a ) b.", "c ( d.", "e"]),
        ("v1.2.3 and 1,000.5 at a.b/c.d end", ["v1.2.3 and 1,000.5 at a.b/c.d end"]),
        ("*若有人。*`假设。`<b>请。</b>完。 x", ["*若有人。*", "`假设。`", "<b>请。</b>", "完。", "x"]),
        ("> ผ่านแล้ว\n> ไม่ต้อง ครับ", ["ผ่านแล้ว\n> ไม่ต้อง", "ครับ"]),
        ("", []), (None, []), (" \n\t\n", []), ("---\n", []), (".", ["."]),
    ],
)
def test_sentences(text, want):
    assert cut(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1. a\n   - b\n   - c\n2. d\n   1. e\n   2. f\n3. g\n5. h", ["a", "b", "c", "d", "e", "f", "g\n5.", "h"]),
        ("1. a\n\n   more of a\n2. b", ["a", "more of a", "b"]),
        ("1. a\n\nsee line\n2. Next", ["a", "see line\n2.", "Next"]),
        ("> 1. a\n>    * b\n> 2. c\n\nd\n3. e", ["a", "b", "c", "d\n3.", "e"]),
        ("- (a\n- b) c. D", ["(a", "b) c.", "D"]),
    ],
)
def test_list_levels(text, want):
    assert cut(text) == want


def test_no_window_decides():
    gap = " " * 60
    assert cut(f"Das ist z.{gap}B. Ruhe.") == [f"Das ist z.{gap}B. Ruhe."]
    long = "a" * 200
    assert cut(f"See {long}/b.ts.Next it is.") == [f"See {long}/b.ts.", "Next it is."]  # a path, however long
    assert cut(f"See {long.upper()}x{long}.Next it is.") == [f"See {long.upper()}x{long}.Next it is."]  # a dotted name
    assert cut(f"See “{long.upper()}x” {long}.Next it is.") == [f"See “{long.upper()}x” {long}.", "Next it is."]


# Sentences per language with what makes their borders hard; any of them may follow any other.
HELD_OUT = {
    "en": ["Dr. Lee asked e.g. for v1.2.3 of src/a.b/c.ts.", 'She said "No. Never!" and left.', "Is it 3.5 percent?", "It closed at 5 p.m. on Monday."],
    "de": ["Am 3. März kam z. B. Frau Dr. Klein.", "Er rief: „Halt. Sofort!“ und ging.", "Das sind ca. 1.000 Zeilen.", "Warum nicht?"],
    "fr": ["M. Blanc part, p. ex. à 8 h.", "Il dit : « Non. Jamais ! » puis sort.", "Pourquoi pas ?", "Le fichier a/b.ts est lu."],
    "es": ["La Sra. Ruiz pide, p. ej., dos.", "¿Por qué no?", "¡Vamos!", "Dijo «No. Nunca.» y salió."],
    "ru": ["Это т. е. 5 строк.", "Он сказал «Нет. Никогда.» и ушёл.", "Почему?", "См. рис. 2 и стр. 4."],
    "zh": ["日志写着“为什么。真的？”然后停了。", "版本3.5可用。", "真的吗？", "看a/b.ts（第二版。）吧。"],
    "ja": ["彼は「止めて。すぐ！」と言った。", "本当？", "版は1.2です。", "終わり！"],
    "hi": ["डॉ. राव आए।", "क्यों?", "यह 3.5 है।", "बस!"],
    "ar": ["قال «لا. أبدا.» ثم خرج.", "لماذا؟", "هذا 3.5 فقط.", "انتهى!"],
}


@pytest.mark.parametrize("lang", sorted(HELD_OUT))
def test_held_out_sentences(lang):
    """Recall and precision of 1 on every order of two sentences, with blanks, line breaks, list items and quotations between."""
    glue = "" if lang in ("zh", "ja") else " "
    for a in HELD_OUT[lang]:
        for b in HELD_OUT[lang]:
            for sep, pre in ((glue, ""), ("\n", ""), ("\n\n", ""), ("\n- ", "- "), ("\n2. ", "1. "), ("\n> ", "> ")):
                assert cut(pre + a + sep + b) == [a, b], (a, b, sep)


def test_sentences_cost_follows_length():
    import time

    for unit in ('"(', "a. ", "( ", "“ ” ", "> ", "z. ", "a.Bb", "a/b.Cd", "1.", "- a\n", "1. a\n  - b\n", "z.   "):
        t = time.time()
        got = sentences(unit * 50_000)
        assert time.time() - t < 20
        assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_sentence_offsets_query(spark, rows):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, ""), (4, "A b. C d.")], "doc_id long, text string").withColumn("doc", F.lit(9))
    assert rows(sentence_offsets(df, "doc_id", "text")) == [(1, 0, 4), (1, 5, 9), (4, 0, 4), (4, 5, 9)]
    assert sentence_offsets(df.limit(0), "doc_id", "text").count() == 0


def test_buckets_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 60), 7)))
        counts = np.array([rng.randrange(1, 9) for _ in sizes])
        cost = lambda ends: sum(ends[-1] * 0 + sum((e - s) * c for s, c, g in zip(sizes, counts, group) if g == e) for e, group in [(e, [next(x for x in ends if x >= s) for s in sizes]) for e in ends]) + 30 * len(ends)
        every = [tuple(sizes[i] for i in range(6) if m >> i & 1) + (sizes[-1],) for m in range(64)]
        assert cost(tuple(length_buckets(sizes, counts, 30))) == min(map(cost, every))


@pytest.mark.parametrize("top_up", [True, False])
def test_plan_keeps_the_rules(top_up):
    rng = random.Random(6)
    hist = {s: rng.randrange(1, 200) for s in rng.sample(range(1, 1001), 120)} | {1000: 5}
    p = plan(hist, 1000, top_up)
    load, count = defaultdict(int), defaultdict(int)
    runs = sorted(zip(p.size, p.rank, p.container, p.each))
    for (s, r, c, e), nxt in zip(runs, [*runs[1:], None]):
        until = nxt[1] if nxt and nxt[0] == s else hist[s]
        for k in range(r, until):
            load[c + (k - r) // e] += s
            count[s] += 1
    assert dict(count) == hist and max(load.values()) <= 1000 and len(load) == p.containers
    if top_up:
        least = max(sum(s * n for s, n in hist.items()) / 1000, sum(n for s, n in hist.items() if s > 500))
        assert p.containers <= 11 / 9 * least + 1


def _containers(p, hist):
    """Items of every container, from the plan's runs."""
    out = defaultdict(list)
    runs = sorted(zip(p.size, p.rank, p.container, p.each))
    for (s, r, c, e), nxt in zip(runs, [*runs[1:], None]):
        for k in range(r, nxt[1] if nxt and nxt[0] == s else hist[s]):
            out[c + (k - r) // e].append(s)
    return out


def test_buckets_decide_the_containers(monkeypatch):
    rng = random.Random(8)
    hist = {s: rng.randrange(1, 60) for s in rng.sample(range(20, 600), 300)}
    by_bucket = plan(hist, 1000)
    with monkeypatch.context() as m:
        m.setattr("depweave.llm.packing.length_buckets", lambda sizes, counts, cost: [int(sizes[-1])])
        one = plan(hist, 1000)
    assert len(by_bucket.boundaries) > 1
    told = lambda p: sorted(sorted(v) for v in _containers(p, hist).values())
    assert told(by_bucket) != told(one) and by_bucket.containers <= 1.01 * by_bucket.used / 1000 + 1
    # no batch leaves the bucket of its longest item while an item of that bucket fits, and most tokens lie in batches of their own bucket
    upper = lambda s: next(b for b in by_bucket.boundaries if b >= s)
    own = sum(s for v in _containers(by_bucket, hist).values() for s in v if upper(s) == upper(max(v)))
    assert own > 0.6 * by_bucket.used
    alone = plan(hist, 1000, top_up=False)
    assert all(len({upper(s) for s in v}) == 1 for v in _containers(alone, hist).values())


def test_pack_assigns_every_text(spark):
    rng = random.Random(7)
    texts = ["a" * rng.randrange(0, 90) for _ in range(500)] + [None, "", "", "é" * 260, "日本" * 40, "x" * 99, "x" * 100] + ["same"] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = pack(df, "doc_id", "text", 100).collect()
    load, seen = defaultdict(int), defaultdict(list)
    for r in got:
        load[r["container"]] += r["tokens"]
        seen[r["doc_id"]].append((r["char_start"], r["char_end"], r["pieces"]))
        assert r["tokens"] == len(texts[r["doc_id"]][r["char_start"] : r["char_end"]].encode()) + 1 <= r["bucket"] <= 100
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert set(seen) == {i for i, t in enumerate(texts) if t is not None}
    for i, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == len(texts[i]) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert (len(parts) > 1) == (len(texts[i].encode()) + 1 > 100) and {p[2] for p in parts} == {len(parts)}
    assert len(load) <= -(-sum(load.values()) // 100) + 2
    assert pack(df.limit(0), "doc_id", "text", 100).count() == 0


def test_gram_hashes_depend_on_the_gram_alone():
    a = np.array([random.Random(9).randrange(5) for _ in range(400)], dtype=np.uint64)
    for q in (1, 2, 3, 7, 16):
        h, seen = gram_hashes(a, q), {}
        assert len(h) == len(a) - q + 1
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(tuple(a[i : i + q]), v) == v
        assert len(set(seen.values())) == len(seen)


def _brute(docs, items, n, m):
    out = set()
    for d, t in docs:
        w = words(t or "")
        s, grams = "".join(w), {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, u, by in items:
            v = words(u or "")
            z = "".join(v)
            if any(z[k : k + m] in s for k in range(len(z) - m + 1)) if by else any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_brute_force(spark, rows):
    rng = random.Random(11)
    vocab = ["a", "b", "ab", "ba", "Straße", "éa", "x1", "日", "本語"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, rng.choice([" ", "-", ", "]).join(say(rng.randrange(0, 12))), i % 4 == 0) for i in range(30)] + [(90, None, False), (91, "", True), (92, "a b", None)]
    items += [(93, items[5][1], False)]
    docs = [(d, " ".join(say(5) + (words(rng.choice(items[:30])[1])[: rng.randrange(3, 12)]) + say(4)).upper()) for d in range(120)] + [(500, None), (501, ""), (502, items[5][1])]
    docs += [(503, " ".join(docs[3][1]))]
    want = _brute(docs, [(i, t, bool(b)) for i, t, b in items], 5, 8)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string, by_letters boolean")
    for block in (10**6, 100):  # all items sent, and the join on q-grams
        got = leaks(df, "doc_id", "text", it, "item_id", "text", "by_letters", 5, 8, block_chars=block)
        assert set(rows(got)) == want and got.count() == len(want)
    assert leaks(df.limit(0), "doc_id", "text", it, "item_id", "text", "by_letters").count() == 0
    assert leaks(df, "doc_id", "text", it.limit(0), "item_id", "text", "by_letters").count() == 0


@pytest.mark.parametrize("edits", [1, 3])
def test_both_ways_of_searching_agree(spark, rows, edits):
    rng = random.Random(edits)
    vocab = [rng.choice("bcdfg") * rng.randrange(1, 3) + rng.choice("aeiou") + rng.choice(["", "r", "nt"]) for _ in range(40)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(3, 25)), i % 3 == 0) for i in range(20)] + [(None, say(20), False), (77, None, True)]
    docs = []
    for d in range(80):
        t = list(rng.choice([x for x in items if x[1]])[1])
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["z"], [t[at], "q"]])
        docs.append((d, say(4) + " " + "".join(t) + " " + say(3)))
    docs += [(None, docs[0][1]), (90, None), (91, "")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, by_letters boolean")
    a, b = (rows(leaks(df, "doc_id", "text", it, "item_id", "text", "by_letters", 6, 20, edits, block)) for block in (10**6, 10))
    assert a == b and any(r[0] is None for r in a) and any(r[1] is None for r in a)
    exact = rows(leaks(df, "doc_id", "text", it, "item_id", "text", "by_letters", 6, 20))
    assert set(exact) < set(a)


def test_normalisation():
    assert words("ﬁne-Tu­ned Ｗord_s ½ İ") == ["fine", "tuned", "word", "s", "1", "2", "i"]


def test_banded_distance():
    arr = lambda s: np.array([ord(c) for c in s], dtype=np.uint64)
    assert banded_distance(arr("abcd"), arr("xabcdx"), 1) == 0
    assert banded_distance(arr("abcd"), arr("abxdyy"), 1) == 1
    assert banded_distance(arr("abcdef"), arr("abcef"), 1) == 1
    assert banded_distance(arr("abcd"), arr("wxyz"), 1) == 2


def test_leaks_with_edits():
    item = "the quick brown fox jumps over the lazy dog and then it rests a while"
    ix = build_index([(1, item, False)], 13, 40, edits=1, q=8)
    assert find(ix, ["so " + item.replace("jumps", "jumqs") + " ok", item.replace("jumps", "leaped"), item, "nothing of the sort"]) and {d for d, _ in find(ix, ["so " + item.replace("jumps", "jumqs") + " ok", item.replace("jumps", "leaped"), item, "none"])} == {0, 2}


def _least_edits(a, text):
    """Edits that turn ``a`` into the nearest stretch of ``text``, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_leaks_with_letters_put_in_or_left_out(edits):
    rng = random.Random(edits)
    item = "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    ix = build_index([(1, item, True)], 13, 60, edits=edits)
    docs = []
    for before in range(edits + 2):  # every place of the diagonals within a band
        for at in range(len(item) + 1):
            other = rng.randrange(len(item))
            for n in range(1, edits + 2):  # one edit more than allowed as well
                for t in (item[:at] + "z" * n + item[at:], item[:at] + item[at + n :], item[:at] + "z" + item[at:other] + item[other + 1 :] if at < other else item):
                    docs.append("x" * before + t + "yy")
    want = {d for d, t in enumerate(docs) if _least_edits(item, t) <= edits}
    assert {d for d, _ in find(ix, docs)} == want and 0 < len(want) < len(docs)
