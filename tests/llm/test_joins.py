"""Set join, components, near-duplicates, shared spans and leaks against brute force, and their defined cases."""

import random
import unicodedata
from itertools import combinations
from math import comb

import pytest

from twinsift.llm import components, leakage, neardup, rolling, setjoin, spans, templates

RULES = "rule_id bigint, features array<int>, sid string, tokens int"


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.85, 0.6, 1.0])
def test_set_pairs_match_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT_LEAST", 6)  # so that combinations of frequent tokens are used too
    draw = random.Random(5)
    sets = {}
    for i in range(160):
        base = set(draw.sample(range(60), draw.choice([3, 5, 9, 16, 22, 30])))
        sets[i] = base
        if i % 2:
            near = set(sets[i - 1])
            near.discard(min(near))
            sets[i] = near | {draw.randrange(60) for _ in range(draw.randrange(3))} or base
    hot = set(range(100, 125))
    for i in range(160, 200):
        sets[i] = hot - {draw.choice(list(hot))}
    rows = [(k, [*v, None, *list(v)[:2]], "x", 1) for k, v in sets.items()] * 2
    records = setjoin.record_sets(spark.createDataFrame(rows, RULES), "rule_id")
    got = {(r["a"], r["b"]) for r in setjoin.expand_pairs(*setjoin.similar_sets(records, threshold)).collect()}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 3 and jaccard(sets[a], sets[b]) >= threshold}
    assert got == want


def test_large_hot_sets_have_bounded_keys_and_match_brute_force(spark, monkeypatch):
    """A third of all sets draw on one vocabulary, with up to a thousand tokens."""
    rule = setjoin.SizeRule(0.85)
    assert all(sum(setjoin.comb(s - setjoin.ceil(rule.t * s) + r, r) for r in setjoin._run_lengths(rule, 3)(s)) <= 3 * setjoin.HOT_KEYS for s in range(1, 4000))
    monkeypatch.setattr(setjoin, "HOT_LEAST", 6)
    draw = random.Random(12)
    sets = {}
    for i, n in enumerate([30, 60, 90, 110, 130, 240, 280, 1000, 1100] * 3):
        base = set(range(n))
        sets[i] = base - set(draw.sample(sorted(base), draw.randrange(n // 14))) | {5000 + draw.randrange(40) for _ in range(n // 40)}
    for i in range(30, 80):
        sets[i] = set(draw.sample(range(9000, 99000), draw.choice([4, 25, 300])))
    records = setjoin.record_sets(spark.createDataFrame([(k, list(v), "x", 1) for k, v in sets.items()], RULES), "rule_id")
    got = {(r["a"], r["b"]) for r in setjoin.expand_pairs(*setjoin.similar_sets(records, 0.85)).collect()}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.85}
    assert got == want and len(want) > 20


def test_set_pairs_defined_cases(spark):
    empty = spark.createDataFrame([], RULES)
    assert setjoin.rule_pairs(empty, empty).count() == 0
    odd = spark.createDataFrame([(1, None, None, None), (2, [], "a", 2), (3, [None, 4, 4], "a", 2), (None, [1, 2, 3], "a", 2), (5, [1, 2, 3], "b", 3), (6, [3, 2, 1, 1], None, 0)], RULES)
    assert [tuple(r) for r in setjoin.rule_pairs(odd, empty).collect()] == [(5, 6, 1.0)]
    assert {tuple(r) for r in setjoin.rule_classes(odd, empty).collect()} == {(5, 5, 0), (6, 5, 0)}


EDGES = "a bigint, b bigint, similarity double, v string, c int, root int"


def edge_table(spark, rows):
    return spark.createDataFrame([(a, b, s, "v", 1, 2) for a, b, s in rows], EDGES)


def groups_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {(find(x), x) for x in parent}


def test_components_of_chains_stars_and_cycles(spark):
    draw = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1120)]
    star = [(5000, 5001 + i) for i in range(80)]
    loose = [(draw.randrange(300), draw.randrange(300)) for _ in range(140)]
    pairs = [p for p in chain + star + loose if p[0] != p[1]]
    rows = [(b, a, 0.9) for a, b in pairs] + [(a, b, 0.95) for a, b in pairs[::3]]
    got = {tuple(r) for r in components.unit_groups(edge_table(spark, rows)).collect()}
    assert got == groups_of(pairs)


def test_components_defined_cases(spark):
    assert components.unit_groups(edge_table(spark, [])).count() == 0
    bad = [(1, None, 0.9), (None, 2, 0.9), (3, 3, 0.9), (4, 5, None), (6, 7, float("nan")), (8, 9, 1.5), (10, 11, 0.2)]
    assert components.unit_groups(edge_table(spark, bad)).count() == 0
    assert {tuple(r) for r in components.unit_groups(edge_table(spark, [*bad, (20, 10, 0.85), (10, 20, 1.0)])).collect()} == {(10, 10), (10, 20)}


FILES = "file_id bigint, repo string, path string, text string, id int, tid int, payload string"


def file_table(spark, texts):
    return spark.createDataFrame([(i, "r", f"{i}.ts", t, 1, 2, "p") for i, t in texts], FILES)


def words(draw, n):
    return " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "x1", "Ünï", "k_2", "zeta", "eta", "theta"]) + str(draw.randrange(9)) for _ in range(n))


def shingle_set(text, k):
    import re

    w = re.findall(r"[a-z0-9_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize(("threshold", "k"), [(0.7, 3), (0.5, 2)])
def test_near_files_match_brute_force(spark, threshold, k):
    draw = random.Random(7)
    texts = []
    for i in range(0, 60, 3):
        t = words(draw, draw.choice([8, 40, 90]))
        parts = t.split()
        parts[len(parts) // 2] = "changed"
        texts += [(i, t), (i + 1, " ".join(parts)), (i + 2, t if i % 2 else words(draw, 5))]
    texts += [(100, None), (101, ""), (102, "one"), (103, "é ü"), (None, texts[0][1]), texts[0]]
    got = {(r["a"], r["b"]) for r in neardup.expand(*neardup.near_files(file_table(spark, texts), threshold, k)).collect()}
    sets = {i: shingle_set(t, k) for i, t in texts if i is not None and t}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= threshold}
    assert got == want and want


def test_near_units_and_classes(spark):
    schema = "unit_id bigint, features array<int>, cid string, size string"
    rows = [(1, [1, 2, 3, 4, 5, None], "x", "y"), (2, [5, 4, 3, 2, 1, 1], "x", "y"), (3, [1, 2, 3, 4], "x", "y"), (4, [], None, None), (5, None, None, None), (6, [9], None, None)]
    members, links = neardup.near_units(spark.createDataFrame(rows, schema), 0.8)
    assert {(r["a"], r["b"]) for r in neardup.expand(members, links).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in neardup.classes(members, links).collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (6, 6, 0)}
    nothing = spark.createDataFrame([], schema)
    assert neardup.near_units(nothing)[0].count() == 0


def test_words_are_ascii_runs_after_lowering():
    texts = ["Hello wörld foo_bar 12 baz", "", "KK İx a b c d a b c", "é" * 10, "x y z " * 5]
    at, hashes = rolling.word_shingles(texts, 3)
    assert [int((at == i).sum()) for i in range(len(texts))] == [len(shingle_set(t, 3)) for t in texts]
    assert len(set(hashes.tolist())) == len(set().union(*(shingle_set(t, 3) for t in texts)))


def test_shared_spans_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spans, "CROWD", 4)  # so that the finer slices are used too
    draw = random.Random(3)
    block = lambda n: "".join(draw.choice("abcdeäß\U0001f600 \n") for _ in range(n))
    shared, short = block(300), block(299)
    texts = [(i, block(200) + (shared if i % 3 == 0 else short if i % 3 == 1 else "") + block(150)) for i in range(24)]
    texts += [(50, "a" * 900), (51, "b" + "a" * 500), (52, shared), (53, shared), (54, short), (55, None), (56, ""), (None, shared), texts[0]]
    got = {tuple(r) for r in spans.file_pairs(file_table(spark, texts)).collect()}
    runs = {i: {t[j : j + 300] for j in range(len(t) - 299)} for i, t in texts if i is not None and t}
    want = {(a, b) for a, b in combinations(sorted(runs), 2) if runs[a] & runs[b]}
    assert got == want and len(want) > 30


def test_signatures_stand_still_over_compact_windows():
    import numpy as np

    draw = random.Random(9)
    text = "".join(draw.choice("abcdef") for _ in range(400))
    length = 60
    key, start, end = spans.signatures(text, length)
    held = {k: [] for k in key.tolist()}
    for k, a, b in zip(key.tolist(), start.tolist(), end.tolist()):
        held[k].append((a, b))
    for i in range(len(text) - length + 1):  # every passage has the keys of its own signature, and lies inside them
        own = set(spans.signatures(text[i : i + length], length)[0].tolist())
        assert len(own) == comb(spans.HASHES, spans.AGREE) and all(any(a <= i and i + length <= b for a, b in held[k]) for k in own)
    assert len(key) < 3 * 4 * spans.HASHES * len(text) / length and len(spans.signatures("short", length)[0]) == 0
    assert np.all(end - start >= length)


def test_near_passages_hold_all_shared_runs(spark):
    draw = random.Random(5)
    block = lambda n: "".join(draw.choice("abcdefghijklm \n") for _ in range(n))
    shared, other = block(360), block(900)
    edited = other[:450] + "#" + other[451:]
    texts = [(1, block(400) + shared + block(90)), (2, shared + block(200)), (3, other), (4, block(50) + edited), (5, block(2000)), (6, "x" * 310), (7, "x" * 310), (8, None), (9, ""), (None, shared), (10, shared[:299]), (1, "")]
    files = file_table(spark, texts)
    found = {}
    for r in spans.near_passages(files).collect():
        found.setdefault(r["file_id"], []).append((r["start"], r["end"]))
    for r in spans.fragments(files).collect():
        assert any(a <= r["start"] and r["end"] <= b for a, b in found[r["file_id"]])
    assert set(found) == {1, 2, 3, 4, 6, 7} and found[6] == [(0, 310)]
    assert all(a >= 200 for a, b in found[1]) and found[3][0][0] <= 5 and found[3][-1][1] >= 895  # near copies over the edit too
    assert spans.near_passages(file_table(spark, [])).count() == 0


def test_shared_part_and_lines(spark):
    draw = random.Random(4)
    run = "".join(draw.choice("abcdefgh\n") for _ in range(400))
    files = file_table(spark, [(1, "x" * 50 + "\n" + run + "\nTAIL"), (2, run), (3, "none of it " * 40)])
    parts = {r["file_id"]: r["shared_chars"] for r in spans.shared_part(files).collect()}
    assert parts[2] == 400 and 400 <= parts[1] <= 402 and 3 not in parts
    row = next(r for r in spans.fragments(files).collect() if r["file_id"] == 2)
    assert (row["start_line"], row["end_line"]) == (1, run[:399].count("\n") + 1)
    assert spans.file_pairs(file_table(spark, [])).count() == 0


def test_leaks_match_brute_force(spark):
    draw = random.Random(6)
    letters = "abcdefghij0123456789 .,ÄéЖ東ไ"
    block = lambda n: "".join(draw.choice(letters) for _ in range(n))
    items = [(i, block(160)) for i in range(12)] + [(20, None), (21, ""), (22, "short"), (None, block(90))]
    items.append((30, items[0][1]))
    docs = []
    for i in range(30):
        inner = items[i % 12][1][20 : 20 + draw.choice([40, 90, 140])]
        docs.append((i, block(50) + (inner.upper() if i % 2 else " ".join(inner)) + block(80)))
    docs += [(90, None), (91, ""), (None, items[1][1])]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id bigint, text string, key string")
    t = spark.createDataFrame([(*x, "k") for x in items], "item_id bigint, text string, key string")

    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if unicodedata.category(c)[0] in "LN")

    want = set()
    for i, text in docs:
        for j, item in items:
            if i is not None and j is not None and text and item:
                a, b = plain(text), plain(item)
                if any(b[k : k + 60] in a for k in range(len(b) - 59)):
                    want.add((i, j))
    got = {tuple(r) for r in leakage.leaks(d, t).collect()}
    assert got == want and want
    assert leakage.leaks(d.limit(0), t).count() == 0


LANGUAGES = {
    "en": ("In {n} the {a} council paid {m} crowns to the {b} board for every single bridge that the engineers had closed before the winter", "Harlow Marlow Stanwick Perrin"),
    "de": ("Im Jahr {n} zahlte der Rat von {a} genau {m} kronen an den Ausschuss von {b} für jede einzelne Brücke die vor dem Winter gesperrt wurde", "Harlstedt Marlau Stannwik Perrin"),
    "fr": ("En {n} le conseil de {a} versa {m} couronnes au comité de {b} pour chaque pont que les ingénieurs avaient fermé avant cet hiver", "Harlieu Marlène Stanvic Perrin"),
    "es": ("En {n} el consejo de {a} pagó {m} coronas al comité de {b} por cada puente que los ingenieros habían cerrado antes del invierno", "Harlena Marlosa Estanvic Perrina"),
    "hi": ("वर्ष {n} में {a} परिषद ने {b} समिति को {m} मुद्राएँ हर उस पुल के लिए दीं जिसे अभियंताओं ने सर्दी से पहले बंद किया था", "हारलोपुर मारलगढ़ स्तानवाल पेरिनाबाद"),
    "ar": ("في عام {n} دفع مجلس {a} إلى لجنة {b} مبلغ {m} من النقود عن كل جسر أغلقه المهندسون قبل الشتاء في كل مدينة", "هارلوبور مارلغار ستانوال بيريناد"),
    "ja": ("{n}年に{a}議会は{b}委員会へ{m}円を支払い、技師たちが冬の前に閉鎖したすべての橋について報告書を提出すると約束しました", "ハルロブル マルロガル スタンヴァル ペリナドル"),
    "zh": ("在{n}年{a}议会向{b}委员会支付了{m}元用于工程师们在冬季之前关闭的每一座桥梁并且承诺提交一份详细的报告给全体议员们", "哈尔罗普 玛勒加尔 斯坦瓦尔 佩里纳德"),
    "th": ("ในปี {n} สภา {a} จ่ายเงินให้คณะกรรมการ {b} จำนวน {m} สำหรับสะพานทุกแห่งที่วิศวกรปิดก่อนฤดูหนาวและสัญญาว่าจะส่งรายงาน", "ฮาร์โลว์ มาร์กัล สแตนวัล เปรินาด"),
}


def template_corpus():
    """In each language an item, documents of the same words in another order, and one that has the item with new values."""
    draw, docs, items = random.Random(8), [], []
    for k, (pattern, names) in enumerate(LANGUAGES.values()):
        a, b, c, d = names.split()
        items.append((k, pattern.format(n=1999, m=250, a=a, b=b)))
        docs.append((1000 + k, pattern.format(n=2004, m=75, a=c, b=d)))
        spaced = " " in pattern
        parts = [x for x in pattern.replace("{", " {").replace("}", "} ").split() if "{" not in x] if spaced else [x for x in pattern.replace("{n}", "|").replace("{m}", "|").replace("{a}", "|").replace("{b}", "|").replace("、", "|").split("|") if x]
        for i in range(60):
            draw.shuffle(parts)
            docs.append((2000 + 100 * k + i, (" " if spaced else "").join(parts)))
    return docs, items


def test_templates_find_new_values_in_nine_languages(spark):
    docs, items = template_corpus()
    docs += [(90, None), (91, ""), (None, items[0][1]), (92, items[0][1]), docs[0]]
    items += [(30, None), (31, ""), (32, "short"), (None, items[0][1])]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id bigint, text string, tokens string")
    t = spark.createDataFrame([(*x, 1) for x in items * 2], "item_id bigint, text string, key int")
    rows = {(r["doc_id"], r["item_id"]): r for r in templates.template_leaks(d, t).collect()}
    assert {(1000 + k, k) for k in range(len(LANGUAGES))} <= set(rows)
    assert all(rows[1000 + k, k]["changed"] >= 2 for k in range(len(LANGUAGES)))
    assert rows[92, 0]["changed"] == 0
    assert {p for p in rows if p[0] < 2000} - {(1000 + k, k) for k in range(len(LANGUAGES))} == {(92, 0)}
    assert templates.template_leaks(d.limit(0), t).count() == 0 and templates.template_leaks(d, t.limit(0)).count() == 0


def test_runs_of_templates_match_brute_force():
    draw = random.Random(4)
    import numpy as np

    def sequence(n):
        code = [draw.choice([1, 2, 9, 10, 11, 12]) for _ in range(n)]
        return np.array(code, np.uint64), [draw.choice("xyz") if c < 3 else str(c) for c in code], np.full(n, templates.WORD)

    def brute(doc, item, run):
        best = 0
        for x in range(len(doc[0])):
            for y in range(len(item[0])):
                told, k, literal = {}, 0, 0
                while x + k < len(doc[0]) and y + k < len(item[0]) and doc[0][x + k] == item[0][y + k]:
                    code = int(item[0][y + k])
                    if code < 3 and told.setdefault((code, item[1][y + k]), doc[1][x + k]) != doc[1][x + k]:
                        break
                    literal += code > 3
                    k += 1
                    if k >= run and 2 * literal >= run:
                        best = max(best, k)
        return best

    for _ in range(150):
        doc, item = sequence(40), sequence(30)
        at, to = draw.randrange(20), draw.randrange(10)
        for i in range(draw.randrange(4, 18)):
            doc[0][at + i], doc[1][at + i] = item[0][to + i], item[1][to + i].replace("x", "w")
        found = templates.agreement(doc, item, 5)
        assert (found[0] if found else 0) == brute(doc, item, 5)


def test_every_run_with_a_fit_window_has_one_indexed():
    import numpy as np

    draw = random.Random(4)
    for _ in range(60):
        codes = np.array([draw.choice([1, 2, 3, 50, 60, 70]) for _ in range(templates.RUN)], np.uint64)
        fit = any((codes[i : i + templates.WORDS] > 3).sum() >= templates.LITERAL for i in range(templates.RUN - templates.WORDS + 1))
        assert (len(templates.windows(codes)) > 0) == fit
        around = np.concatenate([codes[:3], codes, codes[5:9]])
        assert set(templates.windows(codes)) <= set(templates.windows(around)) | set(templates.windows(codes)) and set(templates.windows(codes)) & set(templates.windows(around)) or not fit
