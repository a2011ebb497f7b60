"""Encoding repair, personal information, markup and sentences: round trips, brute force, hand-labelled cases, odd inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import encoding, markup, pii, queries, sentences

CLEAN = {
    "fr": "Le salaire s’élève à 2.100,50 € par mois. J’ai géré 13 dépôts et réduit les délais de 37,9 % en 2015.",
    "de": "Größere Störungen wurden binnen 14 Min. behoben. Wo möchten Sie künftig arbeiten?",
    "es": "¿Tiene usted disponibilidad los fines de semana? Reduje los errores en la línea de producción.",
    "pl": "Dołącz do nas już dziś! Zarządzałem zespołem 6 osób, m.in. w dziale zakupów.",
    "ru": "Я руководил отделом снабжения и сократил расходы на 1,8 %. Звоните сегодня!",
    "en": "The client’s naïve contract became a résumé-ready success. Managed a €33,891 budget.",
}
DECOYS = ["GUÐRÚN TEXTILES, Reykjavík line.", "“IRMÔ was the brand name.", "SELEÇÃO E FORMAÇÃO de equipes fazem parte da função.", "ÂGE MINIMUM : 18 ANS.", "Paid €2k – €135k™ ±3%.", "São Tomé", "à", "plain ASCII & more", "日本語のテキスト。", "Łódź–Zürich", "IÑAKI OSKELIĆ"]


@pytest.fixture(scope="module")
def describer(spark, sf):
    return encoding.Describer(encoding.fit(spark.read.parquet(f"{sf}/documents.parquet")))


@pytest.mark.parametrize("lang", sorted(CLEAN))
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp850"])
def test_utf8_round_trip(describer, lang, codec):
    raw = CLEAN[lang].encode("utf-8")
    try:
        bad = "".join(chr(b) if codec == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(codec) for b in raw)
    except UnicodeDecodeError:
        pytest.skip("not representable")
    fixed, used, _ = encoding.restore(bad, describer)
    assert used and fixed == CLEAN[lang]


@pytest.mark.parametrize("read,written", [("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866")])
def test_single_byte_round_trip(describer, read, written):
    text = "Я руководил отделом снабжения и сократил расходы. Звоните сегодня!"
    fixed, used, _ = encoding.restore(text.encode(written).decode(read), describer)
    assert used and fixed == text


def test_single_byte_round_trip_of_polish(describer):
    text = "Zarządzałem zespołem ośmiu osób, książka i źródło są już gotowe."
    fixed, used, _ = encoding.restore(text.encode("cp1250").decode("cp1252"), describer)
    assert used == ["single:cp1252:cp1250"] and fixed == text


def test_twice_partly_and_lost(describer):
    twice = "coordinated São Tomé crews".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.restore(twice, describer)[0] == "coordinated São Tomé crews"
    part = CLEAN["fr"] + "\n" + CLEAN["de"].encode().decode("latin-1")
    assert encoding.restore(part, describer)[0] == CLEAN["fr"] + "\n" + CLEAN["de"]
    assert encoding.restore("R�ponse sous 48 h", describer)[1:] == (["replaced"], True)
    assert encoding.restore("team&acirc;&euro;&trade;s", describer)[0] == "team’s"


@pytest.mark.parametrize("text", [*CLEAN.values(), *DECOYS])
def test_clean_text_stays(describer, text):
    assert encoding.restore(text, describer) == (text, [], False)


def test_encoding_odd_rows(spark, describer, sf):
    long_ = ("été " * 3000).encode().decode("cp1252")
    df = spark.createDataFrame([(1, None), (2, ""), (3, long_), (3, long_), (4, "x")], "row_num long, text string").withColumn("restored", F.lit("clash"))
    got = encoding.restored(df, ["row_num"], "text", encoding.fit(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    assert [(r.row_num, r.restored) for r in got] == [(3, "été " * 3000)] * 2
    assert encoding.restored(df.limit(0), ["row_num"], "text", {}).count() == 0
    assert encoding.restore("Ã©tÃ©", encoding.Describer({}))[0] == "été"
    word = "é" * 9000  # a very long text without spaces
    assert encoding.restore(word.encode().decode("cp1252"), encoding.Describer({}))[0] == word


MARKUP = [
    ("<p>a</p>", ["html"]), ("x</e\nnext", ["html"]), ("a &nbsp; b", ["html"]), ("&amp;lt;em&amp;gt;x&amp;lt;/em&amp;gt;", ["html"]), ("<!-- c -->x", ["html"]),
    ("**bold** text", ["markdown"]), ("## Head\ntext", ["markdown"]), ("see [p](https://a.example/b)", ["markdown"]), ("Skills\n------\nx", ["markdown"]), ("- [x] done", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
    ("== Head ==\ntext", ["wiki"]), ("'''b''' and ''i''", ["wiki"]), ("[[Desk|the desk]]", ["wiki"]), ("{{cv-item|2010|x}}", ["wiki"]), ("signed ~~~~", ["wiki"]),
    ("\\section{Skills} x", ["latex"]), ("saved 12\\% of costs", ["latex"]), ("$y = \\frac{a}{b}$", ["latex"]),
    ("Team of <7 people, growth >29%", []), ("x < y and y > z", []), ("List<String> in Java", []), ("A -> B <- C", []), ("* fluent in two languages", []), ("- steady hands, - good eyes", []), ("== differs from === in scripts", []),
    ("the matrix [[1,2],[3,36]] here", []), ("Paid $40,000-$55,000 plus costs", []), ("files under C:\\temp\\new\\report.", []), ("Contact <a.b@mail.example> now", []), ("user_id and order_no", []), ("", []), ("plain", []),
    ("<b>x</b> and **y**", ["html", "markdown"]),
]


@pytest.mark.parametrize("text,want", MARKUP)
def test_markup_kinds(text, want):
    assert markup.kinds(text) == want


def test_markup_keeps_structure():
    assert markup.clean("<h2>Head</h2><ul><li>One &amp; two</li></ul>") == "# Head\n\n- One & two"
    assert markup.clean("## Head\n\n* **b** `c`\n\n```\na*b*c\n```") == "# Head\n\n* b c\n\n```\na*b*c\n```"
    assert "$y = \\frac{a}{b}$" in markup.clean("\\textbf{So} $y = \\frac{a}{b}$")
    assert markup.clean("[[Desk|the desk]] '''x'''") == "the desk x"
    assert all(markup.clean(t) == t for t, k in MARKUP if not k)


def test_markup_leaves_code_and_formulas_as_they_are():
    code = "```python\ndef __init__(self, **kwargs):\n    return '<b>%s</b>' % [x](y)\n```"
    assert markup.clean("## Use\n\n" + code) == "# Use\n\n" + code
    assert markup.clean("<p>Run</p><pre><code>if a &lt; b:\n  **x**</code></pre>") == "Run\n\n```\nif a < b:\n  **x**\n```"
    assert markup.clean("\\begin{equation}E=mc^2\\end{equation}") == "$$E=mc^2$$"
    assert markup.clean("\\begin{verbatim}\n\\textbf{x}\n\\end{verbatim}") == "```\n\\textbf{x}\n```"
    assert markup.clean("**So** $a_i * b_j = \\frac{a}{b}$ and <code>a_b_c</code>") == "So $a_i * b_j = \\frac{a}{b}$ and a_b_c"
    assert markup.clean("\\href{http://a.example}{the {x} link}, \\cventry{2010}{Clerk}{Town} {\"a\": {\"b\": 1}}") == "the {x} link, 2010 Clerk Town {\"a\": {\"b\": 1}}"


def test_markup_of_any_length():
    assert markup.clean("a <!-- " + "c\n" * 4000 + "--> b") == "a  b" and markup.kinds("<!--" + "c" * 9000 + "-->") == ["html"]
    assert markup.kinds("`" + "c " * 4000 + "`") == ["markdown"] and markup.kinds("$x = " + "a+" * 4000 + "b$") == ["latex"] and markup.kinds("*" + "e " * 4000 + "e*") == ["markdown"]
    assert markup.clean("<script>if (a<b) f('</p>')</script>x") == "x"


@pytest.mark.parametrize("part", ["<script>", "<b ", "<!--", "`a", "&lt;b ", "{{a", "**a ", "\\textbf{", "\\begin{equation}", "<pre>", "''x"])
def test_markup_takes_linear_time(part):
    import time

    def seconds(n):
        began = time.process_time()
        markup.clean(part * n)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 1.0 + 8 * seconds(4_000)


def test_the_cut_decides_what_signs_of_costs_cannot():
    """A closing mark after a blank, braces and hidden text are content by themselves and residue by their edges."""
    for text in ("**Bold ** text", "\\emph{x} y", "a <!-- c --> b"):
        alone = [[m.prior > 0 for m in c] for c, _ in markup.graphs(text, {})]
        joined = [markup.labels(c, e, {}) for c, e in markup.graphs(text, {})]
        assert all(map(all, joined)) and not all(map(all, alone))


def test_many_arguments_do_not_outvote_their_macro():
    assert markup.kinds("\\cventry{2021}{clerk}{Led a crew}{}{}{Did x}") == ["latex"]


def test_costs_are_learnt_from_structure(spark):
    """Braces confirmed by macros in every text raise their log-odds; forms never confirmed fall."""
    df = spark.createDataFrame([(i, f"\\emph{{x{i}}} and A -> B, List<String> {i}") for i in range(60)], "row_num long, text string")
    costs = markup.fit(markup.packed(df, ["row_num"], "text"))
    brace = next(v for k, v in costs.items() if ".brace" in k)
    typed = next(v for k, v in costs.items() if k.startswith("ht.tag -3"))
    assert brace > markup.BRACE + 0.5 and typed <= -3
    assert markup.fit(markup.packed(df.limit(0), ["row_num"], "text")) == {}


def test_minimum_cut_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 7)
        u = [rng.choice([-2, -1, -0.5, 0.5, 1, 2]) + rng.random() / 50 for _ in range(n)]
        edges = [(i, j, rng.random() * 2) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        g = markup.Cut(u)
        for e in edges:
            g.join(*e)
        cost = lambda s: sum(-x if not k and x < 0 else 0 for x, k in zip([0] * n, s)) + sum(x for x, k in zip(u, s) if x > 0 and not k) - sum(x for x, k in zip(u, s) if x < 0 and k) + sum(c for i, j, c in edges if s[i] != s[j])
        assert cost(g.labels()) == pytest.approx(min(cost(s) for s in itertools.product([False, True], repeat=n)))


def test_markup_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<b>" * 4000), (3, "<b>" * 4000), (4, "x")], "row_num long, text string").withColumn("kind", F.lit("clash"))
    assert sorted((r.row_num, r.kind) for r in markup.found(df, ["row_num"], "text").collect()) == [(3, "html")] * 2
    assert {r.row_num: r.clean_text for r in markup.cleaned(df, ["row_num"], "text").collect()} == {1: None, 2: "", 3: "", 4: "x"}


SENTENCES = [
    ["Mr. Brannby said \"No. Not this year.\" and closed the fleet.", "Holds a Ph.D. in physics and a B.Sc. in design."],
    ["The office relocated to the U.K.", "Prof. Thalby et al. cite my helpdesk on pp. 32-934."],
    ["Joined Wexpoint Inc. in 2006, i.e. two years before the merger.", "Apply now!"],
    ["It was slow... until the audit was balanced.", "\"Can you start on Monday?\" asked the hiring lead.", "She wrote: \"The migration finished on time.\"", "Late shifts end at 6 p.m."],
    ["Im Bereich Küche arbeiten ca. 11 Personen.", "Kenntnisse in Kafka, z. B. aus Projekten, sind erwünscht.", "Wo möchten Sie künftig arbeiten?"],
    ["« Vous êtes engagée ! » s’écria la directrice.", "M. Kavvrade a signé la lettre de référence.", "Nous offrons une prime annuelle, des congés payés, etc. et un véhicule."],
    ["Обязанности: учёт, планирование, контроль и т. п.", "Звоните сегодня!"],
    ["(References are available on request.)", "Apply now!"],
]
WIDE = [["夜勤は可能ですか？", "「いつから働けますか？」と面接官が尋ねた。", "上司は「納期を守れ。品質も守れ。」と繰り返した。"], ["经理说：“项目按时完成了。”", "请尽快投递简历！", "“先试用。再转正。”这是公司的惯例。"], ["ต้นทุนลดลงร้อยละ 82.2 ภายในหนึ่งปี", " ทีมงานดูแลระบบ AutoCAD ตลอด 24 ชั่วโมง", " งานนี้เริ่มต้นในเดือนหน้า"]]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return sentences.fit(docs, rounds=3)


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentences_of_running_text(model, parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.split(text, model)] == parts


@pytest.mark.parametrize("parts", WIDE)
def test_sentences_without_spaces(model, parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences.split(text, model)] == [p.strip() for p in parts]


def test_units_and_positions(spark, model):
    text = "Heading\n\n  1. One item. It has two.\n2. Second\n \nA wrapped\nline here.\n- not a list\n\n* 🚀 x"
    got = [text[a:b] for a, b in sentences.split(text, model)]
    assert got == ["Heading", "1. One item.", "It has two.", "2. Second", "A wrapped\nline here.", "- not a list", "* 🚀 x"] or got == ["Heading", "1. One item.", "It has two.", "2. Second", "A wrapped\nline here.\n- not a list", "* 🚀 x"]
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n \n"), (5, "e\u0301 🚀 end"), (5, "e\u0301 🚀 end"), (6, "word " * 50_000)], "doc_id long, text string").withColumn("start_pos", F.lit("clash"))
    rows = [(r.doc_id, r.start_pos, r.end_pos) for r in sentences.sentences(df, model=model).collect()]
    assert rows.count((5, 1, 8)) == 2 and {r[0] for r in rows} == {1, 5, 6} and (6, 1, 5 * 50_000 - 1) in rows
    assert sentences.sentences(df.limit(0)).count() == 0


def test_posteriors_against_enumeration(model):
    """Forward-backward equals the sum over all sequences of events."""
    run = [(0, 0, "by", "J.", "D.", None), (0, 0, "J.", "D.", "Tredetti", None), (0, 0, "in", "9999.", "Apply", None), (0, 0, "a", "Ph.D.", "in", None)]
    total, ones = 0.0, [0.0] * len(run)
    for s in itertools.product([0, 1], repeat=len(run)):
        p = 1.0
        for k, (_, _, h2, h1, nxt, _) in enumerate(run):
            anew = k and s[k - 1] and run[k - 1][4] == h1
            e = model.event("<S>" if anew else h2, h1, sentences.lower(nxt))
            p *= (e if s[k] else 1 - e) * model.word(nxt, "S:" + sentences.script(h1) if s[k] else h1)
        total += p
        for k, x in enumerate(s):
            ones[k] += p * x
    assert model.posteriors(run) == pytest.approx([x / total for x in ones], abs=1e-9)


def test_sentence_model_counts_every_document_whole(spark, monkeypatch):
    """More rows than any sample, copies among them, and a word behind the first 20,000 characters; counts scale with the words."""
    rows = spark.range(30_000).select(F.concat(F.lit("Unit "), F.floor(F.col("id") / 2).cast("string"), F.lit(" ended.")).alias("text"))
    late = spark.createDataFrame([("pad " * 6_000 + "sent to Zorv. Then on. " * 3,)], "text string")
    words = 30_000 * 3 + 6_000 + 15
    for limit in (10_000_000, 60_000):
        monkeypatch.setattr(sentences, "SCALE_WORDS", limit)
        c, scale = sentences.fit(rows.unionByName(late), rounds=1).c, min(1.0, limit / words)
        assert c["s1", "Unit", ""][1] == pytest.approx(30_000 * scale, abs=1e-5) and c["e1", "Zorv.", ""][1] == pytest.approx(3 * scale, abs=1e-5)
        assert c["n", "N", ""][1] == pytest.approx((6_000 + 15 - 1 - 5 + 60_000) * scale, rel=0.001)


def test_sentences_do_not_hang_on_a_limit_of_words(spark, monkeypatch):
    """The same sentences whether the input is over SCALE_WORDS or not, from the tables as from the model handed out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = []
    for limit in (10**9, 2_000):
        monkeypatch.setattr(sentences, "SCALE_WORDS", limit)
        got += [sorted(map(tuple, sentences.sentences(docs, model=m).collect())) for m in (None, sentences.fit(docs))]
    assert got[0] == got[1] == got[2] == got[3]


def test_pairs_of_words_do_not_outvote_events():
    """However often a pair stands around a gap, events after its left word keep it from being taken for the inside of a sentence."""
    for n in (100, 100_000):
        c = {("e0", "x.", ""): (0.9 * n, n), ("e1", "late.", ""): (0.9 * n, n), ("e2", "was", "late."): (0.9 * n, n), ("n", "S", ""): (0, 100 * n), ("n", "N", ""): (0, 2000 * n), ("s1", "Then", ""): (0, n), ("s2", "L", ""): (0, 100 * n), ("s2", "L", "Then"): (0, n)}
        c |= {("b1", "late.", ""): (0.9 * n, 0.1 * n), ("b1", "late.", "Then"): (0, 0.02 * n), ("b0", "x.", ""): (0.9 * n, 0.1 * n)}
        assert sentences.Model(c).posteriors([(0, 1, "was", "late.", "Then", None)])[0] > 0.7


def test_gaps_take_linear_time():
    import time

    for part in ('"a. b" ', "(((a. ", "a) b] ", "„x. “ ", "「あ。」"):

        def seconds(n, part=part):
            began = time.process_time()
            sentences.read(part * n)
            return time.process_time() - began

        seconds(100)
        assert seconds(16_000) < 1.0 + 8 * seconds(4_000), part


def test_a_sentence_may_begin_with_a_dot():
    text = "Apply now! .NET is used, v. .5 too."
    assert [(text[a:b], nxt) for a, b, _, _, nxt, _ in sentences.gaps(text, 0, 0, len(text))] == [(" ", ".NET"), ("", "")]


@pytest.mark.parametrize("parts", [["Ես աշխատում եմ։", "Նա գալիս է։"], ["እኔ ተማሪ ነኝ።", "እሱ መምህር ነው፧", "አዎ።"], ["ကျွန်တော် သွားမယ်။", "သူ လာမယ်။"], ["ខ្ញុំទៅ។", "គាត់មក។"], ["どうぞ⁉", "Apply now‼", "今すぐ。"]])
def test_stops_of_every_script_have_gaps(model, parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.split(text, model)] == parts


def test_gaps_before_any_sign():
    for nxt in ("'Not yet,' she said.", "’Tis late.", "‚Ja‘, sagte er.", "§ 5 applies.", "· More.", "† Dead.", "*New* stock.", "‐ x"):
        text = "He left. " + nxt
        assert [text[n:] for e, n, _, _, _, sure in sentences.gaps(text, 0, 0, len(text)) if e == 8 and sure is None] == [nxt]
    for nxt in (", Mr. X", ") and", "; then", "… so"):
        text = "etc. " + nxt
        assert not [e for e, n, *_ in sentences.gaps(text, 0, 0, len(text)) if text[n:] == nxt]


def test_a_unit_ends_with_all_its_stops():
    for end in ("." * 40, "!" * 20 + "”" * 20, "." + ")" * 30):
        text = "We stopped" + end
        assert [g[3:] for g in sentences.gaps(text, 0, 0, len(text))] == [(sentences.norm("stopped" + end), "", 1)]


def test_scripts_without_case(model):
    parts = ["نبحث عن موظف لديه خبرة لا تقل عن 29 سنوات.", "نبحث عن موظف لديه خبرة لا تقل عن 20 سنوات.", "قدم د. Ulberello خطاب التوصية في 2014."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.split(text, model)] == parts


def people(spark, extra):
    base = spark.read.parquet("/root/testdata/sf0.01/resume_clean.parquet").select("row_num", F.col("Resume_str").alias("text"))
    return base.unionByName(spark.createDataFrame(extra, "row_num long, text string"))


def test_personal_information(spark):
    extra = [
        (9001, "Name: Leila Brannmont Fax/phone 020 7946 0106 x204"), (9002, "Reported to Xanthe Quillverby, the plant manager."), (9003, "SSN 972-92-6657. Kept lot 900-12-3438 in cold storage."), (9004, "Passport X6424674 valid to 2031. Closed PO 4500039345."),
        (9005, "Reach me via odd.person+x@mail.example.net. Mail: kwame (at) kontakt (dot) test;"), (9006, "Lives at 803 Millrace Hollow Rd., Apt 20A, Hartsend. Covered Harbour Street retail accounts."), (9007, "Lives at 12 Newkind Snicket, Pindale. Used the @channel tag."), (9008, None), (9009, ""), (9010, "x " * 40_000), (9011, "Applicant: VARNELLO, Nadia"), (9011, "Applicant: VARNELLO, Nadia"),
    ]
    got = {}
    for r in pii.items(people(spark, extra).withColumn("kind", F.lit("clash")).withColumn("value", F.lit("clash")), "row_num", "text").where("row_num > 9000").collect():
        got.setdefault(r.row_num, set()).add((r.kind, r.value))
    assert got == {
        9001: {("name", "Leila Brannmont"), ("phone", "020 7946 0106")}, 9002: {("name", "Xanthe Quillverby")}, 9003: {("id_number", "972-92-6657")}, 9004: {("id_number", "X6424674")}, 9005: {("email", "odd.person+x@mail.example.net"), ("email", "kwame (at) kontakt (dot) test")},
        9006: {("address", "803 Millrace Hollow Rd., Apt 20A")}, 9007: {("address", "12 Newkind Snicket")}, 9011: {("name", "VARNELLO, Nadia")},
    }
    red = {r.row_num: r.redacted for r in pii.redacted(people(spark, extra), "row_num", "text").where("row_num > 9000").collect()}
    assert red[9001] == "Name: [NAME] Fax/phone [PHONE] x204" and red[9008] is None and red[9009] == "" and red[9010] == "x " * 40_000
    assert red[9003] == "SSN [ID_NUMBER]. Kept lot 900-12-3438 in cold storage."


def test_a_fitted_model_serves_single_texts(spark, tmp_path):
    """Fitted on one corpus, written, read, and applied to two texts that could teach nothing."""
    pii.fit(people(spark, [(9001, "")]), "text").save(str(tmp_path / "model"))
    model = pii.Model.load(spark, str(tmp_path / "model"))
    few = spark.createDataFrame([(1, "Name: Leila Brannmont Fax/phone 020 7946 0106 x204"), (2, "SSN 972-92-6657. Kept lot 900-12-3438 in cold storage.")], "row_num long, text string")
    assert {(r.row_num, r.kind, r.value) for r in pii.items(few, "row_num", "text", model=model).collect()} == {(1, "name", "Leila Brannmont"), (1, "phone", "020 7946 0106"), (2, "id_number", "972-92-6657")}


def test_candidates_take_linear_time():
    import time

    for part in ("SSN 972-92-6657. ", "a.b@mail.example ", "12 Oak Street, Apt 4, Pindale. "):

        def seconds(n, part=part):
            began = time.process_time()
            pii.candidates(part * n)
            return time.process_time() - began

        seconds(100)
        assert seconds(8_000) < 1.0 + 8 * seconds(2_000), part


def test_no_items_in_empty_tables(spark):
    e = spark.createDataFrame([], "row_num long, text string")
    assert pii.items(e, "row_num", "text").count() == 0 and pii.redacted(e, "row_num", "text").count() == 0


def test_every_query_has_the_columns_asked_for(spark, sf):
    want = {"p2_found": "table_name row_num", "p3_found": "row_num kind found_value", "p4_found": "table_name row_num kind", "p6_found": "table_name row_num term", "p7_found": "job_id resume_id place", "p8_ids": "doc_id ids", "p10_found": "doc_id start_pos end_pos"}
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, sf).columns == cols.split(), name
