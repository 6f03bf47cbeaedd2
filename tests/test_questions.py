from pyspark.sql import functions as F

from tallyroom.functions import cells as fn
from tallyroom.operators import questions as qs
from tallyroom.operators import report, sheets
from tallyroom.workspace import stage

ITEMS = [[None, "Items"], [None, "Code", "Text", "Shuffle"]]


def ask(qid, qtype, *rows):
    return [[qid, "Type", qtype], *rows]


def convert(grid, *books):
    return {(r.workbook_id, r.q_seq): r for r in report.convert(grid(*books)).collect()}


def one(grid, *rows):
    return convert(grid, list(rows))[("w0", 1)]


def test_cells(spark, grid):
    cells = grid([[3.0, 2.5, (0.123456, "0%"), "yes", "-", "x", "", True, 3e9, "1"]])
    got = {r.col_idx: (r.text, r.literal) for r in sheets.with_values(cells).collect()}
    assert got == {0: ("3", "3"), 1: ("2.5", "2.5"), 2: ("0.123456", '"12.346%"'), 3: ("yes", "true"), 4: ("-", "false"),
                   5: ("x", '"x"'), 6: ("", None), 7: ("true", "true"), 8: ("2147483647", "2147483647"), 9: ("1", '"1"')}


def test_an_unreadable_cell_is_fatal_to_its_question_only(grid):
    book = [*ask("Q1", "Info", [None, "Question text", "a"]), *ask("Q2", "Info", [None, "Question text", "b"], [None, "Optional", "+"]),
            *ask("Q3", "Info", ["# not", "read", "c"])]
    cells = grid(book)
    odd = F.when((F.col("row_idx") == 4) & (F.col("col_idx") == 2), "formula").when((F.col("row_idx") == 6) & (F.col("col_idx") == 2), "error")
    got = {r.q_seq: r for r in report.convert(cells.withColumn("cell_type", F.coalesce(odd, F.col("cell_type")))).collect()}
    assert got[2].fatal == "Unreadable cell for question 'Q2' at cell 4:2 - ''" and got[2].doc is None
    assert got[1].fatal is None and got[3].fatal is None  # a comment row is not read


def test_blank_code_stays_an_empty_string(spark):
    text = '{\n  "a":"##JS####JS-END##",\n  "b":"##JS##x\\ny##JS-END##"\n}'
    got = spark.createDataFrame([(text,)], "t string").select(fn.code_unquote(F.col("t")).alias("c")).first().c
    assert got == '{\n  "a":"",\n  "b":x\n         y\n}'


def test_several_shuffle_columns_are_a_warning(grid):
    said = one(grid, *ask("Q1", "RadioGroup", [None, "Items"], [None, "Code", "Text", "Shuffle", "Shuffle"], [None, 1.0, "a", "+", "-"], [None, 2.0, "b", "-", "-"]))
    assert len(said.warnings) == 1 and said.warnings[0].startswith("Multiple shuffle columns found for one table at rows ")


def test_comment_and_blank_rows(grid):
    facts = {r.row_idx: r.skipped for r in sheets.row_facts(grid([["#a"], [None, "#b"], ["", "x"], [""]])).collect()}
    assert facts == {0: True, 1: True, 2: False, 3: True}
    blank = {r.row_idx: r.all_blank for r in sheets.row_all_blank(grid([["", ""], None, ["x"]])).collect()}
    assert blank == {0: True, 1: False, 2: False}


def test_split(grid):
    rows = sheets.split_questions(sheets.row_facts(grid([[""], ["#"], ["Q1"], [""], ["#"], ["Q2"]])))
    assert sorted((r.row_idx, r.q_seq) for r in rows.collect()) == [(2, 1), (3, 1), (4, 1), (5, 2)]
    orphan = sheets.split_questions(sheets.row_facts(grid([["#"], [None, "x"], ["Q1"], ["Q2"]])))
    assert sorted((r.row_idx, r.q_seq) for r in orphan.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_split_is_the_same_in_small_buckets(grid, monkeypatch):
    book = [["Q", "Type", "Info"] if i % 7 == 3 else None if i % 5 == 1 else [None, "a" if i % 3 else "", "b"] for i in range(90)]
    whole = sorted(map(str, sheets.split_questions(sheets.row_facts(grid(book))).collect()))
    monkeypatch.setattr(sheets, "ROWS_AT_ONCE", 4)
    assert sorted(map(str, sheets.split_questions(sheets.row_facts(grid(book))).collect())) == whole


def test_shuffle_settings(spark):
    cases = {"TTT": "true", "FTT": '{"exceptFirst":1}', "TTF": '{"exceptLast":1}', "TFT": '{"except":[1]}', "FFF": None}
    df = spark.createDataFrame([(k, [c == "T" for c in k]) for k in cases], "k string, flags array<boolean>")
    assert {r.k: r.s for r in df.select("k", fn.compact(qs.shuffle_value(F.col("flags"))).alias("s")).collect()} == cases


def test_document_with_a_table(grid):
    got = one(grid, *ask(5.0, "CheckGroup", [None, "Question text", "Why?"], [None, "Optional"], None, *ITEMS,
                         [None, 1.0, "one", "+"], ["#", 9.0, "gone", "+"], [None, 2.0, None, "maybe"], None, [None, "Min answers", 2.0]))
    assert fn_compact(got.doc) == ('{"id":"5","type":"CheckGroup","text":"Why?","optional":null,"items":[{"id":1,"text":"one"},{"id":2}],'
                                   '"shuffleItems":{"exceptLast":1},"minAnswersCount":2}')
    assert got.errors == ["Unexpected cell value. Expected: +, -, Yes, No or empty cell; actual: maybe"]
    assert got.doc.startswith('{\n  "id":"5",\n  "type":"CheckGroup",') and '"items":[{\n    "id":1,' in got.doc


def fn_compact(text):
    import re
    return re.sub("\n *", "", text)


def test_duplicates_and_unknown_rows(grid):
    pad = [None] * 3
    rows = ask("5", "RadioGroup", [None, "Optional", "+"], [None, "Optional", "-"], *pad, None, [None, "What", 1.0], [None, "Else"], None, None, [None, "Odd"])
    got = one(grid, *rows)
    assert fn_compact(got.doc) == '{"id":"5","type":"RadioGroup","optional":true}'
    assert got.errors == [
        "This field was already processed(here: row 1:  | Optional | + | ) for question '5' (RadioGroup) at row 2:  | Optional | - | ",
        "Unrecognized field(s) for question '5' (RadioGroup) at rows 7-8:  | What | 1 |  ...",
        "Unrecognized field(s) for question '5' (RadioGroup) at row 11:  | Odd | "]


def test_table_swallows_its_run(grid):
    got = one(grid, *ask("5", "RadioGroup", [None, "Optional", "+"], *ITEMS, [None, "Optional", "x"], None, [None, "Items"], [None, "Code"], [None, 7.0]))
    assert '"items":[{"id":"Optional","text":"x"}]' in fn_compact(got.doc)
    assert got.errors == ["This field was already processed(here: rows 2-4:  | Items |  ...) for question '5' (RadioGroup) at rows 6-8:  | Items |  ..."]


def test_fatal_errors(grid):
    got = convert(grid, [["5", "Type", "Nope"]], [["6", "Kind", "Info"]], [["7"], [None, None, "x"]], [["8", "Type", "RadioGroup"], [None, "Items"]], [["9", "type"]])
    assert [got[(f"w{i}", 1)].fatal for i in range(5)] == [
        "Unrecognized question type for question '5' at cell 0:2 - 'Nope'",
        "Question type not found for question '6' at cell 0:1 - 'Kind'",
        "Question type not found for question '7'",
        "Empty table for question '8' at row 1:  | Items | ",
        "Unrecognized question type for question '9' at cell Undefined cell coords (Null cell) - ''"]


def test_repeated_ids(grid):
    questions = report.convert(grid([["5", "Type", "Info"]] * 3 + [["5", "Type", "Nope"]]))
    assert [r.note for r in report.duplicate_qids(questions).collect()] == ["Duplicate question id 5: repeated 2 times"]


def test_conjoint_images(grid):
    got = one(grid, *ask("5", "RadioConjoint", [None, "Items"], [None, "Code", "Pic (image)"], [None, 1.0, "u"]))
    assert fn_compact(got.doc) == '{"id":"5","type":"RadioConjoint","items":[{"id":1,"Pic":{"img":"u"}}],"properties":["id","Pic"]}'


def test_matrix_nests_items_and_reports_empty_groups(grid):
    got = one(grid, *ask("5", "CheckGroupMatrix", [None, "Groups"], [None, "ID", "Header"], [None, 1.0, "A"], [None, "1", "B"], None,
                         [None, "Rows"], [None, "Code", "Group", "Item text"], [None, "x", 1.0, "t"]))
    assert fn_compact(got.doc) == ('{"id":"5","type":"CheckGroupMatrix","items":[{"id":1,"header":"A","items":[{"id":"x","text":"t"}]},'
                                   '{"id":"1","header":"B","items":[]}]}')
    assert got.errors == ['No items for group "1"']


def test_code_fields_and_module(grid):
    book = [*ask("5", "Info", [None, "Block", "B1"], [None, "js-on", 'f("a")\ng()']), ["6", "Type", "Info"], [None, "Odd"],
            ["7", "Type", "Nope"], ["8", "Type", "Aliases"], [None, "Aliases"], [None, "Name", "Cond"], [None, "n", 'a "b"'], [None, "m", "function () {}"],
            ["6", "Type", "JsCode"], [None, "Code", "x = 1;"]]
    questions = report.convert(grid(book))
    js = report.render_module(questions).first().js
    lines = js.split("\n")
    assert lines[:5] == ["", " // GENERATED FROM EXCEL FILE", " // DO NOT MODIFY THIS FILE", " // CONSIDER MODIFYING ORIGINAL EXCEL FILE", " "]
    assert '       qs.push({\n         "id":"5",\n         "type":"Info",\n         "cond":isBlock.bind(null, B1),\n         "on":f("a")\n         g()\n       })' in js
    assert "       /* Unrecognized field(s) for question '6' (Info) at row 4:  | Odd |  */ \n       qs.push({" in js
    assert "\r\n\r\n       /* Unrecognized question type for question '7' at cell 5:2 - 'Nope' */\r\n\r\n" in js
    assert "       alias.defineOr('n', \"a \\\"b\\\"\")\n       alias.defineOr('m', function () {})" in js
    assert "\r\n\r\n       x = 1;\n" in js
    assert "##JS" not in js and "/* Duplicate question id 6: repeated 1 times */" in js
    note = report.severity_report(questions).first().notifications
    assert note == ("FATAL ERRORS:\nUnrecognized question type for question '7' at cell 5:2 - 'Nope'\n\n"
                    "ERRORS:\nUnrecognized field(s) for question '6' (Info) at row 4:  | Odd | \n\n"
                    "NOTIFICATIONS:\nDuplicate question id 6: repeated 1 times")


def test_several_shuffle_columns_warn(grid):
    got = one(grid, *ask("5", "RadioGroup", [None, "Items"], [None, "Code", "Shuffle", "Shuffle"], [None, 1.0, "+", "-"], [None, 2.0, "-", "+"]))
    assert got.warnings == ["Multiple shuffle columns found for one table at rows 3-4:  | 1 | + | - |  ..."]
    assert '"shuffleItems":{"exceptLast":1}' in fn_compact(got.doc)


def test_conditions_can_be_joined(spark, grid):
    rows = sheets.split_questions(sheets.row_facts(grid(ask("5", "Info", [None, "Block", "a"], [None, "Block", "b"]))))
    heads = sheets.known_type(sheets.question_type(rows)).drop("rules")
    marked = qs.mark_duplicates(qs.place_rows(qs.match_fields(rows, heads)))
    assert [r.v for r in qs.pair_values(marked).collect()] == ['"##JS##isBlock.bind(null, a)##JS-END##"']
    joined = [r.v for r in qs.pair_values(marked, join_conditions=True).collect()]
    assert joined == ['"##JS##isBlock.bind(null, a) && isBlock.bind(null, b)##JS-END##"']


def test_unknown_columns_behind_a_flag(grid):
    rows = sheets.split_questions(sheets.row_facts(grid(ask("5", "RadioGroup", [None, "Items"], [None, "Code", "What"], [None, 1.0, "x"]))))
    heads = sheets.known_type(sheets.question_type(rows)).drop("rules")
    placed = qs.place_rows(qs.match_fields(rows, heads))
    marked = qs.mark_duplicates(placed)
    tables = qs.tables_of(placed, marked)
    items = qs.row_fields(qs.content_rows(placed, tables))
    assert qs.question_errors(placed, marked, items, tables).count() == 0
    got = [r.error for r in qs.question_errors(placed, marked, items, tables, report_columns=True).collect()]
    assert got == ["Unrecognized column for question '5' (RadioGroup) at cell 2:2 - 'What'"]


def test_every_content_row_has_one_place(spark):
    from tallyroom.plans import questions
    placed = questions._placed(spark, "/root/testdata/sf0.001")
    assert placed.where(~F.col("status").isin("field", "body", "skipped", "unmatched")).count() == 0
    assert placed.groupBy("workbook_id", "row_idx").count().where("count > 1").count() == 0


def test_workbook_routes(spark):
    paths = spark.createDataFrame([("/a/b.csv", True), ("/a/b%20c.xlsx", True), ("/no.xls", False)], "path string, found boolean")
    got = {r.path: (r.read_from, r.error) for r in sheets.workbook_catalog(paths).collect()}
    assert got == {"/a/b.csv": (None, "Only xls and xlsx formats are supported"), "/a/b%20c.xlsx": ("/a/b c.xlsx", None),
                   "/no.xls": (None, "File Not Found: /no.xls")}


def test_rows_meet_their_question_and_titles_by_sorting(grid):
    """Titles and first uses are sums over few rows: no window over rows, and no side that grows with them is broadcast."""
    rows = stage(sheets.split_questions(sheets.row_facts(grid(ask("5", "RadioGroup", *ITEMS, [None, 1.0, "x"])))))
    heads = stage(sheets.known_type(sheets.question_type(rows)).drop("rules"))
    placed = qs.place_rows(qs.match_fields(rows, heads))
    marked = qs.mark_duplicates(placed)
    for df, key in ((placed, "run"), (marked, "field")):
        plan = df._jdf.queryExecution().toString()
        assert "Window [" not in plan and "BroadcastHashJoin [workbook_id" not in plan and f"{key}#" in plan, key


def test_rows_are_evaluated_once_where_they_are_written(spark):
    from tallyroom.operators import ordered
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    plain = spark.range(300).selectExpr("id % 3 as k", "id as i", "id * 7 % 11 as v")
    tracked = plain.mapInArrow(seen, "k long, i long, v long")
    steps = dict(sums={"s": F.col("v")}, mins={"m": F.col("v")}, previous={"p": F.col("v")})
    bucket = F.floor(F.col("i") / 40).cast("bigint")
    got = ordered.running(tracked, ["k"], ["i"], bucket, once=True, written=True, **steps)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ordered.running(plain, ["k"], ["i"], bucket, **steps).collect()))
    assert counted.value == 300


def test_quoting_writes_a_text_once(spark):
    texts = ["[a]", "]", "[", "", '"', '["x"]', "a\nb", "\\", "й", None]
    quoted = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.json_quote(F.col("t")).alias("q"))
    assert quoted._jdf.queryExecution().analyzed().toString().count("to_json") == 1
    assert {r.t: r.q for r in quoted.collect()} == {
        t: None if t is None else '"' + t.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' for t in texts}


def test_tables_are_built_once(grid, monkeypatch):
    """Several branches read a question's marked rows, heads and built tables; each is written before."""
    written = []
    for module in (qs, report):
        monkeypatch.setattr(module, "stage", lambda df, f=module.stage: written.append(df.columns) or f(df))
    assert one(grid, *ask("5", "RadioGroup", *ITEMS, [None, 1.0, "x", "+"])).fatal is None
    assert any("first_row" in c for c in written) and any("keys" in c for c in written) and any("has_type_cell" in c for c in written)
