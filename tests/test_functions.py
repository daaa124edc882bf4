import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens.functions import fuzzy, html, markdown, readings, stats, text, timefn
from fleetlens.operators import documents


def one(spark, expr, **columns):
    row = [tuple(columns.values())] if columns else [(1,)]
    kinds = {str: "string", float: "double", int: "long", dt.date: "date", type(None): "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()) or "x long"
    return spark.createDataFrame(row, schema).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("metric,value,flag", [
    ("motor_temp", -40.0, "below_physical_range"), ("pack_voltage", 0.0, "below_physical_range"),
    ("current_draw", 250.0, "above_physical_range"), ("speed", 0.0, None), ("motor_temp", 66.0, None), ("speed", 130.0, None)])
def test_quality_flag(spark, metric, value, flag):
    _, lo, hi = ref.PHYSICAL_RANGES[metric]
    assert one(spark, readings.quality_flag(F.col("v"), F.lit(lo), F.lit(hi)), v=value) == flag


@pytest.mark.parametrize("actual,baseline,tol,want", [
    (38.0, 28.0, 10.0, (35.7, "above_normal")), (29.0, 28.0, 10.0, (3.6, "normal")), (20.0, 28.0, 10.0, (-28.6, "below_normal")),
    (20.0, None, 10.0, (None, "no_baseline")), (20.0, 0.0, 10.0, (None, "not_applicable")), (30.0, 28.0, 0.0, (7.1, "normal"))])
def test_verdict(spark, actual, baseline, tol, want):
    df = spark.createDataFrame([(actual, baseline, tol)], "a double, b double, t double")
    got = df.select(readings.delta_pct(F.col("a"), F.col("b")), readings.verdict(F.col("a"), F.col("b"), F.col("t"))).first()
    assert tuple(got) == want


def test_physical_warning_text(spark):
    got = one(spark, readings.physical_warning(F.lit("current_draw"), F.col("v"), F.lit("A"), F.lit(-60.0), F.lit(150.0)), v=250.5)
    assert got == "current_draw 250.5 is outside its physical range -60 to 150 A: a sensor fault, not a measurement"


def test_finite(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "s string")
    assert [r[0] for r in df.select(readings.finite(F.col("s"))).collect()] == [1.5, None, None, None, None]


def test_hash_ignores_spacing_only(spark):
    h = lambda s: one(spark, text.content_hash(F.col("s")), s=s)
    assert h("a  b\r\nc\n\n\n\n") == h("a b\nc")
    assert h("A b\nc") != h("a b\nc")


@pytest.mark.parametrize("s", ["V-042", "v42", "v 42", "V_0042", "V-42", "v.042", " V42 "])
def test_seven_spellings(spark, s):
    assert one(spark, text.normal_id(F.col("s")), s=s) == "V42"


def test_codes_and_facts(spark):
    assert one(spark, text.codes(F.col("s")), s="ERR_401, then ERR_12 and ERR_401; err_9 TOOLONG_12") == ["ERR_401", "ERR_12"]
    facts = one(spark, text.facts(F.col("s")), s="A 2.9 kWh pack, 85 km/h top, Rs 1,10,000 and 2.9 kWh")
    assert facts == {"battery_kwh": ["2.9"], "top_speed_kmph": ["85"], "price_inr": ["110000"]}


def test_numbers_ignore_names_dates_versions(spark):
    s = "V‑042 drew 1,234.5 A (+36%) on 2026-09-30 with 3.2.0, ERR_401, range 25–40, −3.1 [e3]"
    assert one(spark, text.numbers(F.col("s")), s=s) == ["1,234.5", "+36", "25", "40", "-3.1"]


def test_traces(spark):
    ok = lambda raw, v, p: one(spark, text.traces(F.col("raw"), F.col("v"), F.col("p"), 1.0), raw=raw, v=v, p=p)
    assert ok("36", 36.0, 36.4) and ok("36.4", 36.4, 36.38) and ok("100", 100.0, 100.9)
    assert not ok("38", 38.0, 36.4)


def test_clauses_split_on_contrast_words(spark):
    got = one(spark, text.clauses(F.col("s")), s="due to load, although wear stays; butter is fine but no")
    assert [c.strip() for c in got] == ["due to load", "wear stays", "butter is fine", "no"]


def test_replacements(spark):
    m = {"Brand Model X": "M1", "Brand": "B"}
    assert one(spark, text.replace_terms(F.col("s"), m), s="brand model x by BRANDs") == "M1 by Bs"
    assert one(spark, text.replace_terms(F.col("s"), m, whole=True), s="Brand Model X by Brands, Brand") == "M1 by Brands, B"
    assert one(spark, text.remaining_terms(F.col("s"), ["psi", "bar"]), s="collapsible at 3 bar") == ["bar"]


def test_scrub_and_call_key(spark):
    assert one(spark, text.scrub(F.col("s")), s="postgres://u:pw@h/db gsk_abcdefghij12") == "postgres://u:***@h/db ***"
    a = F.create_map(F.lit("sql"), F.lit("SELECT  1"), F.lit("a"), F.lit("x"))
    b = F.create_map(F.lit("a"), F.lit("X"), F.lit("sql"), F.lit("select 1"), F.lit("n"), F.lit(None).cast("string"))
    assert one(spark, text.call_key(F.lit("t"), a)) == one(spark, text.call_key(F.lit("t"), b))


def test_front_matter(spark):
    meta, body = text.front_matter(F.col("s"))
    df = spark.createDataFrame([('---\ntitle: "A: b"\nmodels: [X, Y]\n---\nbody\n',), ("no front matter",)], "s string")
    rows = df.select(meta.alias("m"), body.alias("b")).collect()
    assert rows[0]["m"] == {"title": "A: b", "models": "X, Y"} and rows[0]["b"] == "body\n"
    assert rows[1]["m"] == {} and rows[1]["b"] == "no front matter"


def test_front_matter_lists_and_repeated_keys(spark):
    meta, body = text.front_matter(F.col("s"))
    df = spark.createDataFrame([("---\ntitle: one\nmodels:\n  - M1\n  - M2\ntitle: two\nempty:\n---\nx",), ("---\ntitle: open",), (None,)], "s string")
    rows = df.select(meta.alias("m"), body.alias("b"), text.as_list(meta["models"]).alias("l")).collect()
    assert rows[0]["m"] == {"models": "M1, M2", "title": "two", "empty": ""} and rows[0]["l"] == ["M1", "M2"] and rows[0]["b"] == "x"
    assert rows[1]["m"] == {} and rows[1]["b"] == "---\ntitle: open"


def test_bad_documents_are_rows_with_an_error(spark):
    raws = ["---\ndomain: business\ndomain: diagnostic\nuploaded_by: me\n---\nbody", "---\ndomain: business\n---\n \n", "no matter", "---\ndomain: business\ntrust: none\n---\nx"]
    out = documents.resolve_metadata(spark.createDataFrame(list(enumerate(raws)), "doc_id long, raw string")).orderBy("doc_id").collect()
    assert [r["error"] for r in out] == [None, "no content", "unknown domain", "unknown trust level"]
    assert (out[0]["domain"], out[0]["uploaded_by"], out[0]["doc_type"], out[1]["uploaded_by"]) == ("diagnostic", "me", "document", "unknown")


def test_blocks_that_end_a_paragraph():
    got = markdown.blocks("The codes:\n| A | B |\n|---|---|\n| x \\| y | 2 |\nafter\n\nTitle\nof two\n======\n\nsub\n---\n\n    code line\n\n    more\n\nend")
    assert [(b["kind"], b["section"]) for b in got] == [
        ("paragraph", []), ("table", []), ("paragraph", []), ("code", ["Title of two", "sub"]), ("paragraph", ["Title of two", "sub"])]
    assert got[1]["rows"] == [["x | y", "2"]] and got[3]["text"] == "    code line\n\n    more"


def test_codes_are_those_of_the_text_alone(spark):
    body = "# ERR_900\n\nSee ERR_901:\n| Code | Meaning |\n|---|---|\n| ERR_902 | x |\n\nplain words"
    rows = documents.chunk_documents(spark.createDataFrame([(1, "ERR_401 guide", body)], "doc_id long, title string, body string")).orderBy("position").collect()
    assert [(r["chunk_type"], r["error_codes"]) for r in rows] == [("table", ["ERR_902"]), ("table_row", ["ERR_902"]), ("prose", [])]
    assert rows[0]["content"].startswith("ERR_401 guide > ERR_900\n\nSee ERR_901:")


def ranges(spark, day, **kw):
    rows = one(spark, timefn.periods(F.col("d"), **kw), d=dt.date.fromisoformat(day))
    return {r["period"]: (str(r["lo"]), str(r["hi"])) for r in rows}


def test_calendar(spark):
    r = ranges(spark, "2026-10-01")
    assert r["this week"] == ("2026-09-25", "2026-10-01") and r["last quarter"] == ("2026-07-01", "2026-09-30")
    assert r["last month"] == ("2026-09-01", "2026-09-30") and r["this year"] == ("2026-01-01", "2026-10-01")
    f = ranges(spark, "2026-10-01", year_start_month=4, week_mode="calendar_week")
    assert f["this quarter"][0] == "2026-10-01" and f["this week"] == ("2026-09-28", "2026-10-01")
    label = lambda d, m: one(spark, timefn.quarter_label(F.col("d"), m), d=dt.date.fromisoformat(d))
    assert label("2026-02-01", 4) == "Q4 FY2025" and label("2026-08-09", 1) == "Q3 2026"


def test_half_open_bounds(spark):
    df = spark.sql("SELECT timestamp'2026-09-30 18:29:59' AS a, timestamp'2026-09-30 18:30:00' AS b")
    day = F.lit("2026-09-30").cast("date")
    got = df.select(timefn.in_zone(F.col("a"), day, day, "Asia/Kolkata"), timefn.in_zone(F.col("b"), day, day, "Asia/Kolkata")).first()
    assert tuple(got) == (True, False)


@pytest.mark.parametrize("passed,n,want", [(33, 46, (57.5, 82.7)), (3, 3, (43.9, 100.0)), (26, 46, (42.2, 69.8)), (0, 0, (None, None))])
def test_wilson(spark, passed, n, want):
    df = spark.createDataFrame([(passed, n)], "p long, n long")
    assert tuple(df.select(stats.wilson_low(F.col("p"), F.col("n")), stats.wilson_high(F.col("p"), F.col("n"))).first()) == want


@pytest.mark.parametrize("x,y,want", [([1, 2, 3, 4], [1, 2, 3, 4], 1.0), ([3, 3, 3], [3, 3, 3], None), ([1], [1], None),
                                      ([1, 4, 1, 4], [4, 1, 4, 1], -1.0), ([1, 2, 3, 4], [1, 2, 3, 3], 0.875)])
def test_kappa(spark, x, y, want):
    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
    assert df.agg(stats.weighted_kappa(F.col("x"), F.col("y"))).first()[0] == want


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_fuzzy_kernels():
    import random
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in "ab")
        assert fuzzy.common_subsequence(a, b) == plain_lcs(a, b)
    assert fuzzy.token_set("range low on v-042", "on v-042 range low why") == 100.0
    assert fuzzy.token_set("why is v-042's range so low", "why did range drop on v-042?") >= 55
    assert fuzzy.token_set("and v-017?", "why is v-042's range so low") < 55
    assert fuzzy.token_set("", "a") == 0.0


def test_trigram_similarity(spark):
    assert one(spark, fuzzy.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)


def test_unlike_texts_are_told_apart_by_their_first_letters():
    import random
    r = random.Random(2)

    class Read(str):
        seen = 0

        def __getitem__(self, at):
            Read.seen = max(Read.seen, at.stop)
            return str.__getitem__(self, at)

    for n in range(400):
        a = "".join(r.choice("abc ") for _ in range(r.randint(0, 150)))
        b = list(a)
        for _ in range(r.randint(0, 20)):
            at = r.randrange(len(b) + 1)
            b[at:at + r.randint(0, 2)] = [r.choice(["", "a", "c c"])]
        b = "".join(b)
        both = fuzzy.common_subsequence(a, b)
        apart = len(a) + len(b) - 2 * both
        for most in (0, apart - 1, apart, apart + 7.5, 1000):
            got = fuzzy.near_subsequence(a, b, most, r.choice([1, 7, 64]))
            assert got == both if apart <= most else len(a) + len(b) - 2 * got > most
    a, b = (Read("".join(r.choice("abcdefghijkl") for _ in range(4000))) for _ in range(2))
    fuzzy.near_subsequence(a, b, 400)
    assert 0 < Read.seen < 2000


TABLE = "| Code | Meaning | Action |\n|---|---|---|\n" + "\n".join(f"| ERR_{i} | thing {i} | fix {i} |" for i in range(400, 440))


def test_long_table_stays_whole_with_caption_and_rows():
    out = markdown.chunks(f"# Title\n\n## Codes\n\nThe codes:\n\n{TABLE}\n", "Title")
    kinds = [c["chunk_type"] for c in out]
    assert kinds == ["table"] + ["table_row"] * 40
    assert out[0]["content"].startswith("Title > Codes\n\nThe codes:\n\n| Code") and out[0]["content"].endswith("| fix 439 |")
    assert out[1]["content"] == "Title > Codes\n\nCode: ERR_400 | Meaning: thing 400 | Action: fix 400"


def test_prose_overlap_stays_in_its_section():
    para = "word " * 150
    out = markdown.chunks(f"# T\n\n## A\n\n{para}\n\n{para}\n\n## B\n\nshort\n", "T")
    assert [c["section_path"] for c in out] == ["A", "A", "B"]
    assert out[2]["content"] == "T > B\n\nshort"
    first, second = out[0]["content"], out[1]["content"]
    body = second.split("\n\n", 1)[1]
    assert body.startswith("word word") and len(body) > len(para.strip()) and len(first) < 820


def test_sections_lists_and_code():
    got = markdown.blocks("intro\n\n- a\n- b\n\n```\n# not a heading\n```\n\n# H\n\n## S\n\ntext\n\n# I\n\nend")
    assert [(b["kind"], b["section"]) for b in got] == [
        ("paragraph", []), ("list", []), ("code", []), ("paragraph", ["H", "S"]), ("paragraph", ["I"])]
    assert markdown.chunks("- a\n- b", "T")[0]["chunk_type"] == "list"


def test_long_text_is_kept_whole():
    words = [f"w{i}" for i in range(3000)]
    out = markdown.chunks(" ".join(words), "T", overlap=0)
    assert all(len(c["content"]) <= 800 + 3 for c in out)
    assert " ".join(c["content"].split("\n\n", 1)[1] for c in out).split() == words


def test_page():
    p = html.read_page("<html><head><title> A &amp; B</title><script>x()</script></head><body><nav>menu</nav><main><h1>Hi</h1>"
                       "<table><tr><th>k</th><td>1 <b>2</b></td></tr></table><p>one<br>two</p><p>x</p></main><p>outside</p></body></html>")
    assert p == {"title": "A & B", "text": "Hi\none\ntwo", "tables": [[["k", "1 2"]]]}
