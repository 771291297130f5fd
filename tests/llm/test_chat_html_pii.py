import hashlib
import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat_format as cf
from tessella.llm import pii
from tessella.llm.html_text import extract_text, html_to_text

TRICKY = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "<\\|", "\n", "user", "é", "a", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "<|im_end|>", "\\n"]), TRICKY), max_size=5))
def test_format_round_trip(turns):
    pieces = [cf.render(*t) for t in turns]
    assert cf.parse("".join(p for p, *_ in pieces)) == turns
    for (role, text), (piece, begin, end) in zip(turns, pieces):
        assert (begin is not None) == (role == "assistant")
        if begin is not None:
            assert cf.unescape(piece[begin:end]) == text
    assert all("<|" not in cf.escape(t) for _, t in turns)


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "it", "output": "done", "meta": {"a": [1]}}, "instruction", [("user", "do\nit"), ("assistant", "done")]),
    ({"prompt": "p", "response": "r", "system": "s"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": {"x": 1}, "answer_id": 2}, "unknown", []),
    ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"role": None, "text": None}, "turn_row", [("", "")]),
    ({"turns": [{"role": "user", "text": "t"}]}, "turns", [("user", "t")]),
]


@pytest.mark.parametrize(("record", "layout", "turns"), RECORDS)
def test_layouts(record, layout, turns):
    key, name, got = cf.Canonicaliser().turns(record)
    if layout != "unknown":
        assert (name, got) == (layout, turns)
    assert key == cf.fingerprint(cf.field_paths(json.loads(json.dumps(record))))


PART = {"type": "text", "text": "p"}


@pytest.mark.parametrize(
    ("content", "text"),
    [([PART, "q"], "p\nq"), ([PART, {"type": "image", "url": "u"}], 'p\n{"type": "image", "url": "u"}'), ([], ""), ([None, 3], "\n3"), ({"text": "x"}, '{"text": "x"}'), ([["a"], PART], "a\np")],
)
def test_content_parts_are_read_message_by_message(content, text):
    plain = {"role": "user", "content": "plain"}
    for messages in ([{"role": "user", "content": content}], [{"role": "user", "content": content}, plain]):
        assert cf.Canonicaliser().turns({"messages": messages})[1:] == ("messages", [("user", text), *[("user", "plain")] * (len(messages) - 1)])


def test_unknown_records_stay_whole_beside_the_pieces(spark):
    """Extra columns, even with the names of the result, are not read."""
    rows = [("a", '{"other": "kept"}', 5, "x"), ("b", "{broken", 6, None), ("c", '{"messages": [{"role": "user", "content": "t"}]}', None, "y"), ("d", None, 7, "z")]
    df = spark.createDataFrame(rows, "conv_id string, record string, turn int, piece string")
    got = {r.conv_id: r for r in cf.format_records(df, "conv_id", "record").collect()}
    assert {k: r.unformatted for k, r in got.items()} == {"a": '{"other": "kept"}', "b": "{broken", "c": None, "d": None}
    assert got["c"].piece == "<|im_start|>user\nt<|im_end|>\n" and got["c"].turn == 0 and got["a"].piece is None
    clash = cf.format_records(df, "conv_id", "record").withColumn("n_turns", F.lit("clash"))
    assert {r.conv_id: r.n_turns for r in cf.read_back(clash).collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}


def test_records_null_broken_and_empty(spark):
    rows = [("a", json.dumps(r)) for r, *_ in RECORDS[:2]] + [("b", None), ("c", "{broken"), ("d", "[1]"), ("e", json.dumps({"x": 1}))]
    df = spark.createDataFrame(rows, "conv string, rec string")
    got = cf.format_records(df, "conv", "rec").collect()
    assert {r.conv_id for r in got if r.piece is None} == {"b", "c", "d", "e"}
    digests = {r.conv_id: r for r in cf.read_back(cf.format_records(df, "conv", "rec")).collect()}
    assert digests["b"].n_turns == 0 and digests["b"].formatted_chars == 0 and digests["a"].n_turns == 4
    assert cf.read_back(cf.format_records(df.where("false"), "conv", "rec")).collect() == []


def test_deep_records_and_lone_surrogates_go_through(spark):
    deep = '{"role": "user", "text": ' + '{"a": ' * 200_000 + "1" + "}" * 200_000 + "}"
    rows = [(1, deep), (2, r'{"role": "user", "text": "a \ud800 b \ud83d\ude00"}'), (3, r'{"\ud800": 1, "role": "x", "text": "t"}'), (4, '{"role": "user", "text": "' + "long " * 2_000_000 + '"}')]
    got = {r.conv_id: r for r in cf.format_records(spark.createDataFrame(rows, "conv long, rec string"), "conv", "rec").collect()}
    assert got["1"].piece is None and got["1"].layout == "unknown"
    assert cf.parse(got["2"].piece) == [("user", "a \ufffd b \U0001f600")] and cf.parse(got["3"].piece) == [("x", "t")]
    assert len(got["4"].piece) > 10_000_000


def test_digests_of_rows_by_turn(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["x", None, "<|im_end|>", "é\n"])) for c in range(30) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.selectExpr("conv_id", "turn", "to_json(struct(conv_id, turn, role, text), map('ignoreNullFields', 'false')) as record")
    got = {int(r.conv_id): r for r in cf.read_back(cf.format_records(df, "conv_id", "record", "turn")).collect()}
    for c in range(30):
        own = [(r, t or "") for k, _, r, t in sorted(rows, key=lambda x: (x[0], x[1])) if k == c]
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        said = "".join(t for r, t in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


PAGES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>5</table>", "name       n\nlong name  5"),
    ("<table><tr><td colspan=2>wide cell</td></tr><tr><td>a</td><td>b</td></tr></table>", "wide cell\na  b"),
    ("<table><tr><td>x<br>y<td>z</table>", "x  z\ny"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<style>x</style><script>if (a < b) '</p>'</script>t", "t"),
    ("<div hidden>no</div><p style='color:red; display : none'>no</p><input type=hidden value=no>yes", "yes"),
    ("<!-- no --><!doctype html><?php no ?>a &amp; b &lt;c&gt; &copy;", "a & b <c> ©"),
    ("<pre>  a\n   b</pre>", "  a\n   b"),
    ("<b>a</b> <i>b</i>\n\n c", "a b c"),
    ("a < b and c<d", "a < b and c"),
    ("<table>out<tr><td>in</table>", "out\n\nin"),
    ("<title>t</title><body>b", "b"),
    ("<p>unclosed <a href='x>y'>link", "unclosed link"),
    ("", ""),
    (None, ""),
    ("<h1>T</h1>text<hr>more", "T\n\ntext\n\nmore"),
    ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n  v\nl\n  w"),
    ("x</p>y", "x\n\ny"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_rendering(html, text):
    assert html_to_text(html) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<!--", "-->", "<", "&amp;", "<br>", "w1", " w2 ", "<script>", "</script>"]), max_size=40).map("".join))
def test_any_markup_renders(html):
    html_to_text(html)


MORE = [
    ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>", "A  b1\n   b2"),
    ("<table><tr><td>a<td rowspan=0>R<td>c<tr><td>dd<td>e</table>", "a   R  c\ndd     e"),
    ("<style>.x, p#y {display:none} li { visibility: hidden }\n@media print { b { display: none } }</style><b class='a x'>no</b><p id=y>no</p><p>yes<i class=x style='display:inline'> shown</i><ul><li>no</ul><b>b</b>", "yes shown\n\nb"),
    ("<style>p.a {display:block} p {display:none}</style><p class=a>one<p>two", "one"),
    ("<style>/* p{display:none} */ div > p {display:none}</style><p>one", "one"),
    ("<details><summary>s</summary>no<p>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<ol type=a start=26><li>x<li>y<li value=3>z</ol>", "z. x\naa. y\nc. z"),
    ("<ol reversed><li>x<li>y</ol><ol type=I><li>x<li value=4>y</ol>", "2. x\n1. y\n\nI. x\nIV. y"),
    ("<table>" * 60 + "<tr><td>in" + "</table>" * 60, "in"),
]


@pytest.mark.parametrize(("html", "text"), MORE)
def test_spans_rules_details_and_counters(html, text):
    assert html_to_text(html) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=4), min_size=1, max_size=5))
def test_cells_start_at_their_column(rows):
    """Spans expanded into a matrix, cell by cell: all cells that start in one column start at one place of their lines."""
    matrix: dict[tuple[int, int], str] = {}
    html, name, column = "<table>", 0, {}
    for y, row in enumerate(rows):
        html, x = html + "<tr>", 0
        for cols, down in row:
            while (y, x) in matrix:
                x += 1
            word = f"w{name}" + "x" * (name % 3)
            for dy in range(down):
                for dx in range(cols):
                    matrix.setdefault((y + dy, x + dx), word)
            html, name, column[word] = html + f"<td colspan={cols} rowspan={down}>{word}", name + 1, x
            x += cols
    text = html_to_text(html + "</table>")
    places: dict[int, set[int]] = {}
    for line in text.split("\n"):
        for m in re.finditer(r"\S+", line):
            places.setdefault(column[m[0]], set()).add(m.start())
    assert re.findall(r"\S+", text) == list(column)
    if sum(map(len, rows)) > 3:
        wide = [w for w in column if matrix and sum(v == w for v in matrix.values()) > 1]
        assert wide or all(len(p) == 1 for p in places.values())


def test_padding_stays_in_proportion():
    page = "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>"
    text = html_to_text(page)
    assert len(text) < 10 * len(page) and text.count("b") == 2000
    page = "<table><tr>" + "<td rowspan=9999>c" * 3000 + "<tr><td>d" * 3000 + "</table>"
    assert len(html_to_text(page)) < 10 * len(page)
    page = "<table><tr><td>" + "<br>".join("k" * 9 for _ in range(5000)) + "<td>z" * 3000 + "</table>"
    assert len(html_to_text(page)) < 10 * len(page)


STRAY = [
    ("<table><form><tr><td>x</td></tr></form></table>", "x"),
    ("<table><tr><form><td>x</td></form></tr></table>", "x"),
    ("<table><div>note</div><tr><td>x</table>", "note\n\nx"),
    ("<table><b>text</b><tr><td>x</table>y", "text\n\nx\n\ny"),
    ("<table><tr><a>text</a><td>x<td>y</table>", "text\n\nx  y"),
    ("<table><b>text<tr><td>x</table>", "text\n\nx"),
    ("<table><tr><td>a<table><tr><i>i<td>b</table></table>", "ai\n\nb"),
    ("<table><tr><table><tr><td>x</table>y", "x\n\ny"),
    ("<table><colgroup>t<tr><td>x</table>", "t\n\nx"),
    ("a<xmp><b>x</b> &amp;</xmp>b", "a\n\n<b>x</b> &amp;\n\nb"),
    ("<svg><title>no</title><defs><text>no</text></defs><path d='' /><text>s</text><text>t</text></svg>u", "s\nt\nu"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
]


@pytest.mark.parametrize(("html", "text"), STRAY)
def test_stray_elements_keep_their_text(html, text):
    assert html_to_text(html) == text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<table>", "<tbody>", "<tr>", "</tr>", "<td>", "</td>", "</table>", "<form>", "</form>", "<caption>", "<colgroup>", "<col>", "<ul>", "<li>", "<b>", "</b>", "<a>", "word "]), max_size=40))
def test_any_markup_keeps_every_word(parts):
    assert html_to_text("".join(parts)).count("word") == parts.count("word ")


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=4), lambda kids: st.tuples(st.sampled_from(["div", "p", "span", "section", "ul", "li", "b", "h2"]), st.lists(kids, max_size=3)), max_leaves=12))
def test_no_visible_word_is_lost(tree):
    def write(x):
        return " ".join(x) + " " if isinstance(x, list) else f"<{x[0]}>{''.join(map(write, x[1]))}</{x[0]}> "

    def words(x):
        return x if isinstance(x, list) else [w for k in x[1] for w in words(k)]

    assert re.findall(r"[a-h]", html_to_text(write(tree))) == words(tree)


def test_pages_deep_long_and_clashing(spark):
    rows = [(1, None), (2, "<div>" * 30_000 + "deep"), (3, "<p>" + "word " * 100_000), (3, "<p>again")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 4), (3, 5), (3, 499_999)]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = {}
    for kind, pattern in BASE.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((d if k % 2 == 0 else d * 2 - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(digits))))
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                spans.append(m.span())
        out[kind] = spans
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1@.+-% 45(9)é", max_size=60) | st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "999.1.1.1", "a@b.co", "+1 (222) 333-4444", ".", "-", " ", "@", "1", "x"]), max_size=12).map("".join))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_trees_separate_and_thresholds_hold():
    x, y, _ = pii.training_set(3000, seed=99)
    model, thresholds = pii.fit()
    p = model.probability(x)
    assert ((p > 0.5) == y).mean() > 0.85
    assert set(thresholds) == set(pii.KINDS)


def test_spans_match_a_plain_reading(spark):
    """Candidates, tree probabilities node by node, thresholds and the greedy choice, one text at a time."""
    rng = random.Random(3)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [lambda: f'token = "{secret()}"', lambda: f"commit {secret()}", lambda: number(16), lambda: "a.b@c.org", lambda: f"call ({number(3)}) {number(3)}-{number(4)}", lambda: f"ssn {number(3)}-{number(2)}-{number(4)}", lambda: f"order no. {number(3)}-{number(2)}-{number(4)}", lambda: "iban DE89370400440532013000", lambda: "jo at mail dot com"]
    texts = ["words " + " and ".join(rng.choice(made)() for _ in range(rng.randrange(4))) + " end" for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, thresholds = pii.fit(df)

    def probability(kind, text, b, e):
        x, raw = pii.features(kind, text, b, e), 0.0
        for feat, cut, value in model.trees:
            node = 0
            while feat[node] >= 0 and node < 2**model.depth - 1:
                node = 2 * node + 1 + (x[feat[node]] > cut[node])
            raw += value[node]
        return 1 / (1 + math.exp(-(model.platt[0] * raw + model.platt[1])))

    got = {r.doc_id: r for r in pii.find_pii(df, (model, thresholds)).collect()}
    for k, text in enumerate(texts):
        base = [(kind, b, e) for kind, spans in brute(text or "").items() for b, e in spans]
        kept = list(base)
        judged = [(probability(*c[:1], text, *c[1:]), *c) for c in pii.candidates(text or "")]
        for p, kind, b, e in sorted(judged, key=lambda c: (-c[0], c[2], -c[3], c[1])):
            if p >= thresholds[kind] - 1e-12 and all(e <= y or z <= b for _, y, z in kept):
                kept.append((kind, b, e))
        kept.sort(key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))
        assert got[k].spans == ",".join(f"{a}:{b}:{e}" for a, b, e in kept) and got[k].n_spans == len(kept)
    found = [k for k, t in enumerate(texts) if t and "token" in t and got[k].spans.count("secret") >= t.count("token")]
    assert len(found) >= 0.9 * sum("token" in (t or "") for t in texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["jo", "a.b", " at ", "(at)", " [at] ", "  at ", "\tat\n", "mail", ".com", " dot ", "(dot)", "org", " ", "x" * 70, "é", "12"]), max_size=14).map("".join))
def test_spelled_emails_match_the_pattern(text):
    assert pii.spelled_emails(text) == [m.span() for m in pii.SPELLED.finditer(text)]


def test_labels_of_corpus_candidates(spark):
    base = pii.base_spans
    label = lambda kind, text, b, e: pii.weak_label(kind, text, b, e, base(text))
    assert label("card", "4111 1111 1111 1111", 0, 19) == 1 and label("card", "4111 1111 1111 1112", 0, 19) == 0
    assert label("secret", "token = abc", 8, 11) == 1 and label("secret", "commit abc", 7, 10) == 0 and label("secret", "say abc", 4, 7) is None
    assert label("ip", "1:2:3:4:5", 0, 9) == 0 and label("ip", "2001:db8::1", 0, 11) is None
    df = spark.createDataFrame([(1, "4111 1111 1111 1112 "), (2, None), (3, 'key = "' + "0a" * 20 + '"')] * 5, "doc_id string, text string")
    x, y, kinds = pii.corpus_candidates(df, per_kind=3)
    assert len(x) == len(y) == 6 and sorted(zip(kinds, y.tolist(), strict=True)) == [("card", 0.0)] * 3 + [("secret", 1.0)] * 3
    assert {r.doc_id for r in pii.find_pii(df).collect()} == {"1", "2", "3"}


def test_every_labelled_candidate_teaches(spark):
    """The first leaf and the first cut follow from the labels of all candidates, read one by one, and nothing depends on how rows are dealt."""
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"{'order' if k % 10 else 'ssn'} no. {number(3)}-{number(2)}-{number(4)} then" for k in range(6000)] + ["commit " + "0a" * 20] * 3000 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {r[0] for r in df.where("text is not null and pmod(xxhash64(text), 4) = 0").select("text").collect()}
    x, y, n = [], [], []
    for text in (t for t in texts if t and t not in held):
        for kind, b, e in pii.candidates(text):
            if (label := pii.weak_label(kind, text, b, e, pii.base_spans(text))) is not None:
                x.append(pii.features(kind, text, b, e))
                y.append(label)
                n.append(1)
    kinds = [kind for t in texts if t for kind, b, e in pii.candidates(t) if pii.weak_label(kind, t, b, e, pii.base_spans(t)) is not None]
    assert kinds.count("national_id") == 6000
    made = pii.made_up()
    for row, label, kind, out in zip(*made, np.random.default_rng(3).random(len(made[1])) < 0.25, strict=True):
        if not out:
            x.append(row)
            y.append(label)
            n.append(1 + kinds.count(kind) // 2000 if kind in ("national_id", "secret") else 1)
    x, y, n = np.array(x), np.array(y), np.array(n)
    model, thresholds = pii.fit(df.repartition(7))
    feat, cut, value = model.trees[0]
    right = x[:, feat[0]] > cut[0]
    for node, rows in ((0, n > 0), (1, ~right), (2, right)):
        assert abs(value[node] - 0.3 * (n * (y - 0.5))[rows].sum() / (n[rows].sum() / 4 + 1)) < 1e-3
    again, same = pii.fit(df.coalesce(1))
    assert thresholds == same and model.platt == again.platt
    assert all(np.array_equal(a, b) for t, u in zip(model.trees, again.trees, strict=True) for a, b in zip(t, u, strict=True))


def test_cells_send_rows_the_same_way():
    x, _, _ = pii.training_set(2000, seed=5)
    model, _ = pii.fit()
    assert np.array_equal(model.raw(x), model.raw(pii.from_codes(pii.to_codes(x))))


def test_pii_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.org or (555) 123-4567 call"), (3, "x"), (4, 'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" end'), (5, "1" * 200_000), (6, "plain words at home. And more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "'y' as n_email")
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert by[1].spans == by[2].spans == by[6].spans == "" and by[6].redacted == rows[-1][1]
    assert by[4].spans.startswith("secret:9:") and by[4].redacted == 'token = "[SECRET]" end'
    three = next(r for r in got if r.doc_id == 3 and r.n_email)
    assert three.base_sha256 == hashlib.sha256(b"email:5:14").hexdigest() and "email:5:14" in three.spans
    assert pii.find_pii(df.where("false")).collect() == []


@pytest.mark.parametrize("span", ["0123456789abcdef" * 13, "abcdefghijklmnopqrstuvwxyz" * 2 + "0a7c9e2b4d6f8" * 3, "k_" + "Zx9Qw3" * 60])
def test_secrets_of_any_length(spark, span):
    text = f'token = "{span}" end'
    assert ("secret", 9, 9 + len(span)) in pii.candidates(text)
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.redacted == 'token = "[SECRET]" end'


@pytest.mark.parametrize("span", ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:db8:85a3::8a2e:370:7334", "::1", "dead::beef", "fe80::"])
def test_compressed_addresses_are_proposed(span):
    assert pii.candidates(f"address {span}, then") == [("ip", 8, 8 + len(span))]
    assert not pii.candidates("std::vector x::y 12:30 a:b")


def test_compressed_addresses_are_found(spark):
    rows = [(1, "the server address is 2001:db8::1 now"), (2, "host = fe80::1ff:fe23:4567:890a, then"), (3, "login ip: 2001:db8:85a3::8a2e:370:7334 ok"), (4, "call a::b(c) here")]
    got = {r.doc_id: r.redacted for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "the server address is [IP] now", 2: "host = [IP], then", 3: "login ip: [IP] ok", 4: rows[3][1]}


def test_style_text_is_read_in_one_pass():
    """A megabyte of style text without braces, thousands of equal rules and thousands of elements take seconds at most, not hours."""
    begin = time.perf_counter()
    assert html_to_text("<p>a</p><style>" + "x y; " * 200_000).strip() == "a"
    rules = "".join(f"div{{color:red;display:{'none' if k % 2 else 'block'}}}" for k in range(4000))
    page = f"<style>{rules}.b{{display:none}}</style>" + "<div class='a'>x</div>" * 4000 + "<p class='b'>y</p><p>z</p>"
    assert html_to_text(page).split() == ["z"]
    assert time.perf_counter() - begin < 20


def test_the_prefilter_lets_every_candidate_through():
    rng = random.Random(12)
    parts = ["john.smith", "at", "(at)", "[at]", "\t", "\n", " ", "\xa0", "example", "dot", ".", "com", "abcd:", "ef:", "ab", "::", ":", "-", "Token_secretvalue", "x" * 80, "DE", "fe"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        found = pii.candidates(text)
        assert pii.ANY.search(text) or not found, text
    assert pii.ANY.search("john.smith\tat\texample dot com") and pii.candidates("john.smith\tat\texample dot com")
    assert [c[0] for c in pii.candidates("abcd:" * 7 + "abcd")] == ["ip"]


def test_spelled_addresses_are_taken_whole():
    local, host = "a" * 80, "b" * 90
    text = f"write to {local} (at) {host} dot example dot information now"
    (kind, b, e), *_ = pii.candidates(text)
    assert kind == "email" and text[b:e] == f"{local} (at) {host} dot example dot information"
    begin = time.perf_counter()
    pii.candidates("a" * 500_000 + " at " + "b" * 500_000 + " (at) " * 50_000)
    assert time.perf_counter() - begin < 10
