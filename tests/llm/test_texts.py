"""Tokenizer, syntax, hand-written files and sentences: round trips, brute force and worked cases."""

import random

import pytest

from twinsift.llm import handwritten, sentences, syntax, tokenizer

ODD = ["", "plain text, it's fine", "<|endoftext|> is text", "tab\t\r\n\n  spaces   ", "naïve café 東京 ไทย हिन्दी العربية", "\U0001f469\U0001f3fd‍⚖️ ok", "x" * 3000, " " * 500 + "end", "1234567890.5e-3", "\x00\x07‮"]


def test_ids_equal_the_public_library():
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    bpe = tokenizer.encoder("byte_bpe_50k", tokenizer.TOKENIZER_DIR)
    draw = random.Random(1)
    texts = ODD + ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(160, 0x2FFF)])) for _ in range(60)) for _ in range(200)]
    for text in texts:
        assert bpe.encode(text) == public.encode(text, add_special_tokens=False).ids
        assert b"".join(next(k for k, v in bpe.ranks.items() if v == i) for i in bpe.encode(text)[:5]) == text.encode()[: len(b"".join(next(k for k, v in bpe.ranks.items() if v == i) for i in bpe.encode(text)[:5]))]


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    slots = tokenizer.PerfectHash(keys)(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_every_document_has_ids(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "hello world", "x")]
    got = tokenizer.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in got) == [(0, (64,)), (1, (31373, 995)), (1, (31373, 995)), (2, ()), (3, ())]
    assert tokenizer.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


VALID = {
    "a.ts": [
        "import a, { b as c } from './x';\nimport * as d from \"y\";\nexport default function (x?: number, ...r: string[]): void { return; }\n",
        "export abstract class A<T extends object = {}> extends B<T> implements C, D {\n  private readonly x: Map<string, number[]> = new Map();\n  static #p = 1;\n  get y(): T | undefined { return this.#q?.z!; }\n  async *m<K extends keyof T>(k: K, v = 3) { yield* f(k); }\n}\n",
        "type F = (a: string, b?: number) => Promise<void>;\ntype M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };\nenum E { A = 1, B, 'c' = 2 }\ninterface I extends J { (x: number): string; new (): I; m?(): void; [k: string]: unknown }\n",
        "const f = async <T,>(x: T): Promise<T> => x as unknown as T;\nlet y = <number>z;\nconst g = cond ? (a) : b;\nfor (const [k, { v = 1 }] of Object.entries(o)) if (k) continue; else break;\n",
        "label: for (;;) { do { x++ } while (x < 3); break label }\nconst s = `a ${b ? `c ${d}` : '}'} e`;\nconst r = /[/\\]]+/gi.test(x) ? a / b / c : 1;\nswitch (x) { case 1: case 2: { break } default: y() }\ntry { a() } catch { b() } finally { c() }\n",
        "declare module 'x' { export const y: number; }\nnamespace N.M { export type Q = 1 }\nfunction over(a: string): void;\nfunction over(a: any) { debugger }\n",
    ],
    "a.tsx": ["const x = (\n  <div a=\"1\" b={2} {...p}>\n    text, it's {list.map((i) => <li key={i}>{i}</li>)} &amp; {/* none */}\n    <br /> <></>\n  </div>\n);\n"],
    "a.js": ["'use strict'\nvar a = 1\nlet of = 2, b = function () { return }\n;(function () { return a })()\nx = y => ({ y, [z]: 1, get w() { return 1 }, async m() {}, 'k': 2, 3: 4 })\nif (a) b(); else c()\nconst { p, q: [r], ...s } = t\na?.b?.[c]?.(d) ?? e\nclass K { static { init() } f = () => {} }\nexport { a as default, b }\nawait import('x')\nfor await (const x of y) z\n"],
    "a.css": ["@charset \"utf-8\";\n@import url(foo.css) screen;\n:root { --x: { a }; --Y : 1px }\n@media (min-width: 1px) and (max-width: 2px) { a > b + c ~ d, [data-x=\"}\"]:not(.e, .f)::before { color: rgb(1 2 3 / 50%) !important; background: url(data:a;b) } }\n@font-face { font-family: x; src: url('y') }\n@keyframes k { from { top: 0 } 50%, to { top: calc(1px + (2px * 3)) } }\n/* } */ .a { content: \"/* { */\"; &:hover { b: c } }\n"],
    "a.json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "3"],
}
INVALID = {
    "a.ts": ["function f( {\n", "const x = ;\n", "let s = 'open\n", "/* open", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "const a = [1, 2\n", "}\n", "a b\n", "const t = `open ${a}", "class A { m( { } }\n", "return 1;\n", "const x = <li className='a'>b</li>;\n", "x = “y”;\n", "if x) {}\n", "type T = { a: ;\n", "foo(1,, 2);\n", "const f = (a: string, b) ;\n", "for (const x of) {}\n", "import { a from 'b';\n"],
    "a.tsx": ["const x = <div><b></div>;\n", "const x = <div a=>1</div>;\n", "const x = <div>}</div>;\n"],
    "a.js": ["let x: number = 1;\n", "interface A { a: string }\n", "enum E { A }\n", "const y = <b>1</b>;\n", "function f(a: string) {}\n", "class A { x: string; }\n", "{\"a\": 1}\n", ".a { color: red; }\n"],
    "a.css": [".a { color: red;\n", ".a { color: 'red; }\n", "/* open", ".a { color: red; } }\n", "// no\n.a { color: red }\n", "const x = 1;\n", ".a { color red; }\n", ".a { color: red\n margin: 0; }\n", "<<<<<<< HEAD\n.a { b: c }\n", ".a { b: (c; }\n", "text\n"],
    "a.json": ["{\"a\": 1,}", "{'a': 1}", "// c\n{}", "{\"a\": NaN}", "[1 2]", "{\"a\": \"b}", "  "],
}


@pytest.mark.parametrize(("path", "text"), [(p, t) for p, ts in VALID.items() for t in ts])
def test_valid_texts(path, text):
    assert syntax.syntax_error(path, text) is None


@pytest.mark.parametrize(("path", "text"), [(p, t) for p, ts in INVALID.items() for t in ts])
def test_invalid_texts(path, text):
    assert syntax.syntax_error(path, text)


def test_a_field_ends_before_a_long_comment():
    assert syntax.syntax_error("a.ts", "class A {\n  x = 1\n  /* " + "c" * 300 + " */ y\n  z\n" + " " * 300 + "w = 2\n}\n") is None


def test_checks_are_linear_in_awkward_texts():
    import time

    began = time.time()
    for path, text in [("a.css", "a" + " " * 20_000 + "| {}"), ("a.css", "a /*" + "x" * 20_000 + "*/ ! {}"), ("a.ts", "f" + "(" * 20_000), ("a.ts", "// a\n" * 5_000 + ";"), ("a.json", "[" * 50_000), ("a.tsx", "x = " + "<a>" * 5_000)]:
        syntax.syntax_error(path, text)
    assert time.time() - began < 20


def test_failures_and_rates(spark):
    schema = "file_id bigint, repo string, path string, ext string, text string, message string"
    rows = [(1, "r", "a.ts", ".TS", "const x = ;", "m"), (1, "r", "a.ts", ".TS", "const x = ;", "m"), (2, "r", "b.ts", None, "ok();", "m"), (3, "r", "c.md", ".md", "((", "m"), (4, None, "d.json", None, "{", None), (5, "r", None, None, "(", None), (6, "r", "e.ts", None, None, None), (7, "r", "f.ts", None, "", None), (None, "r", "g.ts", None, "(", None)]
    table = spark.createDataFrame(rows, schema)
    assert {r["file_id"] for r in syntax.failures(table).collect()} == {1, 4}
    rates = {(r["repo"], r["language"]): (r["files"], r["failed"], r["rate"]) for r in syntax.failure_rates(table).collect()}
    assert rates == {("r", "ts"): (2, 1, 0.5), (None, "json"): (1, 1, 1.0)}
    assert syntax.failures(table.limit(0)).count() == 0


HAND = "import { load } from './store';\n\nexport function readOrders(customer, limit) {\n  const orders = load(customer).filter((order) => order.open);\n  // The parser output is auto-generated, this caller is not.\n  return orders.slice(0, limit);\n}\n"
KINDS = {
    "generated": "/* eslint-disable */\n" + "".join(f"export const FIELD_NAME_{i} = 0x{i * 7919 % 65536:x};\n" for i in range(14)),
    "minified": "".join(f"function a{i}(b){{return b.c(d{i},{i})}}var e{i}=f.g||!{i};" for i in range(40)) + "\n",
    "vendored": "/*! brightlib v3.2.1 | (c) the brightlib contributors | MIT */\n(function (root, factory) {\n  root.brightlib = factory();\n}(this, function () {\n  return {};\n}));\n",
    "data": "export const points = [\n" + "".join(f"  {i * 733 % 9999}, {i * 577 % 9999}, {i * 911 % 9999},\n" for i in range(60)) + "];\n",
}


def test_kinds_of_files(spark):
    schema = "file_id bigint, repo string, path string, text string, kind string, bits string"
    hand = [(100 + i, "shop", f"src/h{i}.ts", HAND.replace("Orders", f"Orders{'abcdefgh'[i]}"), None, None) for i in range(8)]
    rows = hand + [(i, "shop", f"src/{k}.js", t, "k", "b") for i, (k, t) in enumerate(KINDS.items())]
    rows += [(20, "shop", "vendor/x.css", ".a { color: red }\n", None, None), (21, "shop", "src/y.ts", None, None, None), (22, "shop", None, "x", None, None), (23, "shop", "src/z.ts", " \n", None, None), rows[0], (24, "shop", "src/own.ts", "/*\n * Copyright (c) 2024 the shop authors.\n */\n" + HAND, None, None)]
    table = spark.createDataFrame(rows, schema)
    got = {r["file_id"]: r["kind"] for r in handwritten.classify(table).collect()}
    assert got == {**{i: k for i, k in enumerate(KINDS)}, 20: "vendored"}
    verdicts = {r["file_id"]: r["verdict"] for r in handwritten.named_verdicts(table).collect()}
    assert verdicts[0] == "template" and all(verdicts[h[0]] is None for h in hand) and len(verdicts) == 8 + 4 + 2
    assert handwritten.classify(table.limit(0)).count() == 0


def test_banners_far_from_the_start():
    licence = "/*\n" + " * This text belongs to the shop.\n" * 200 + " */\n"
    generated = lambda t, k=0: handwritten.top_marks(t, k, handwritten.GENERATED_BANNER)
    library = lambda t: handwritten.top_marks(t, 0, handwritten.LIBRARY_BANNER) or handwritten.top_marks(t, 0, handwritten.VERSION_BANNER, True)
    assert generated(licence + "// Code generated by x. DO NOT EDIT.\n" + HAND) and generated(HAND + licence + "/* @generated */\n" + HAND)
    assert library(licence + "/** @license MIT */\n" + HAND) and library(HAND * 9 + "/*! brightlib v3.2.1 */\n" + HAND)
    for first in ("#!/usr/bin/env node\n", "\ufeff", "'use strict';\n"):
        assert library(first + "/* brightlib v3.2.1 */\n" + HAND) and handwritten.MODULE_WRAPPER.match(first + "(function (root, factory) {")
    assert generated('{"//": "Code generated by x. DO NOT EDIT.", "a": 1}', 2)
    assert not generated('const head = "Code generated by x. DO NOT EDIT.";\n') and not library(HAND + "// node 12.1 can do this\n" + HAND)
    assert not generated("function f() {\n  // Code generated by x. DO NOT EDIT.\n}\n")


def test_counters_are_kept_by_template():
    assert handwritten.counter_run("".join(f"const FIELD_{i} = load();\n" for i in range(17, 22))) == 5
    assert handwritten.counter_run("".join(f"get{w}{i}() {{}}\n" for i, w in enumerate(["Cursor", "TableRow", "Quota", "BarnLeaseTray"]))) == 4
    assert handwritten.counter_run("x = 0; a1 = pad(2); wait3(4, b); 5; // 0 1 2 3 4 5 6\nleft: 9, top: 3") <= 2
    assert handwritten.counter_run("id: 3, n: 7\nid: 4, n: 7\nid: 9\nid: 10") == 2


def test_a_counter_is_weighed_by_the_names(spark):
    few = "".join(f"export const ROUTE_{i} = open();\n" for i in range(11, 16))
    long = "".join(f"export function {a}{b}Order() {{ return {b}{a}(); }}\n" for a in "abcdefghij" for b in "klmnop") + few.replace("export const", "let")
    rows = [(1, "shop", "src/few.ts", few), (2, "shop", "src/long.ts", long), (3, "shop", "src/text.ts", HAND + "// 0 1 2 3 4 5 6 7\n")]
    table = spark.createDataFrame(rows, "file_id bigint, repo string, path string, text string")
    assert {r["file_id"]: r["kind"] for r in handwritten.classify(table).collect()} == {1: "generated"}


def test_names_alone_tell_mangled_and_template_files(spark):
    nouns = "order price basket stock ledger ticket invoice parcel cargo harbour".split()
    hand = [(i, "shop", f"src/h{i}.{'ts' if i % 2 else 'js'}", HAND + "".join(f"function {a}{b.title()}(value) {{ return value; }}\n" for a in nouns[i % 7 :] for b in nouns[: 5 + i % 5])) for i in range(20)]
    draw = random.Random(3)
    mangled = "".join("{0}={1}({2});".format(*("".join(draw.choice("qxzjkvwQXZJ9$") for _ in range(3)) + "_" for _ in range(3))) + ("\n" if i % 3 == 0 else "") for i in range(80))
    template = "".join(f"export const orderBasketPrice{7 * i * i % 901} = open();\n" for i in range(1, 15))
    table = spark.createDataFrame([*hand, (50, "shop", "src/m.js", mangled), (51, "shop", "src/t.ts", template)], "file_id bigint, repo string, path string, text string")
    verdicts = {r["file_id"]: r["verdict"] for r in handwritten.named_verdicts(table).collect()}
    assert verdicts == {**{i: None for i in range(20)}, 50: "mangled", 51: "template"}
    assert {r["file_id"]: r["kind"] for r in handwritten.classify(table).collect()} == {50: "minified", 51: "generated"}
    assert not handwritten.packed(mangled) and handwritten.counter_run(template) < handwritten.STEPS


def test_names_of_several_texts():
    found = handwritten.Names(["let ab = cd + ab; 12x", ".a-b { c: d }\n#e:hover {}", '{"k1": {"k-2": "v"}}', "é"], [0, 1, 2, 0])
    words = found.words()
    assert [sorted(w for w, r in zip(words, found.row.tolist()) if r == i) for i in range(4)] == [["ab", "cd", "let"], ["a-b", "e"], ["k-2", "k1"], []]
    row, tri = found.trigrams()
    assert len(row) == sum(len(w) + 1 for w in words)


CASES = [
    "Mr. J. R. Ashby spoke at 3 p.m. on Tuesday.| The U.K. style was approved, cf. vol. 2, pp. 3–4.| He left at 4 p.m.| The house rose.",
    "Asked Mrs. Lund: \"The bill is late.| It is.\"| Next item.".replace("late.| It", "late. It"),
    "\"Is it so?\" said the minister.| No!!| Well... perhaps not.| Done …| The end.",
    "Ms HALL (Centre): The vote was lost.| (Applause.)| [Interruption]| It was [Hear, hear!] close.",
    "Der Rat tagt am 10. Mai z. B. in Bonn.| Nach § 5 Abs. 4.| „Das stimmt?“ fragte Frau Dr. Roth.| Gut.",
    "L'art. 5 vaut 3,5 % env. 20 km.| « Est-ce vrai ? » a lancé Mme Roy.| Fin.",
    "¿La mesa aprueba?| ¡Sí!| Dijo el Sr. Gil: «No. Nunca.»| Fin.",
    "政府推迟了法案。|部长说：“不行。再议！”|（笑声）|完成？",
    "大臣は「ハナ」という案を支持します。|「よいですか？」と議員は述べました。|〔拍手〕|終わり。",
    "सरकार ने पृ. 5 के डॉ. राम को देखा।| क्या?| ठीक।",
    "قال د. سالم: «نعم.»| انتهى.| هل؟| لا.",
    "สภาเปิด| รัฐบาลเลื่อนแผน| (ปรบมือ)| “ดี”สมาชิกกล่าว",
    "the vote was lost.| our group left at 3 p.m. on monday.| \"was it?\" asked mr. lund.| yes.",
    "Order of business|\n\n3 – Lund|\r\n \r\nThe line\nbreaks here.| Next.",
    "It ended.|The next began.|Then more came.|Over.",
]


@pytest.mark.parametrize("marked", CASES)
def test_sentence_cases(marked):
    text, ends, at = "", [], 0
    for part in marked.split("|"):
        text += part
        ends.append(len(text))
    assert sentences.sentence_ends(text) == ends


def test_sentences_cover_every_text(spark):
    schema = "doc_id bigint, text string, lang string, sent_end int"
    rows = [(1, "One. Two.", "de", 1), (2, None, None, None), (3, "", None, None), (4, " \n\n ", None, None), (None, "A.", None, None), (5, "no end", None, None)]
    got = sorted((r["doc_id"], r["sent_end"]) for r in sentences.split_sentences(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 4), (1, 9), (5, 6)]
    draw = random.Random(8)
    for _ in range(300):
        text = "".join(draw.choice("ab .!?\"“”„«»「」()[]\n\r。？A1…ก") for _ in range(80))
        ends = sentences.sentence_ends(text)
        assert ends == sorted(set(ends)) and (not text.strip() or ends[-1] == len(text.rstrip()))
        assert "".join(text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])) == text
    long = "The house agreed. " * 20_000
    assert len(sentences.sentence_ends(long)) == 20_000


@pytest.mark.parametrize("units", range(1, 8))
def test_interruptions_follow_the_sentence_around_them(units):
    """Inside a sentence any number of them is part of it; between sentences each is one of its own."""
    inside = "We agree so " + "(Applause) " * units + "that the bill stands. Next one."
    assert sentences.sentence_ends(inside) == [len(inside) - 10, len(inside)]
    between = "We agree so. " + "(Applause) " * units + "The bill stands."
    assert len(sentences.sentence_ends(between)) == units + 2


def test_sentences_take_time_in_proportion():
    import time

    for piece in ("we go on with it. then ", "hum ho... ", "(x) ", "“a b. "):
        took = []
        for n in (2_000, 8_000):
            began = time.perf_counter()
            sentences.sentence_ends(piece * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 0.5
