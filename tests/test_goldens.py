"""Small fixed cases of the library: expected values from the survey's goldens and traps."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folio.functions import geometry as g
from folio.functions import labels as lab
from folio.functions import text as tx
from folio.operators import blocks as blk
from folio.operators import catalogue as cat
from folio.operators import imports as imp
from folio.operators import jobs, layout
from folio.operators import replies as rep
from folio.streaming.session import state_store


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def box(*v):
    return g.bbox(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize(("given", "expected"), [((-30, 10, 1200, 1500), (0, 10, 1000, 990)), ((1000, 0, 5, 5), (1000, 0, 0, 5)), ((math.nan, math.inf, math.nan, 5), (0, 0, 1, 5))])
def test_clamp(spark, given, expected):
    assert tuple(one(spark, b=g.clamp_bbox(box(*given))).b) == expected


def test_geometry(spark):
    o = lambda b: g.offset_bbox(b, F.lit(16.0), F.lit(16.0))
    assert tuple(one(spark, b=o(box(100, 100, 80, 120))).b) == (116, 116, 80, 120)
    assert tuple(one(spark, b=o(box(80, 90, 220, 260))).b) == (96, 106, 220, 260)
    s, l = g.apply_bbox_edit(box(1, 2, 3, 4), box(80, 90, 220, 260), box(120, 140, 240, 280))
    r = one(spark, s=s, l=l)
    assert tuple(r.s) == (1, 2, 3, 4) and tuple(r.l) == (120, 140, 240, 280)
    for size, expected in (((3000, 1500), (1900, 950)), ((1000, 1400), (1000, 1400)), ((1, 5000), (1, 1900))):
        w, h = g.scaled_size(F.lit(size[0]), F.lit(size[1]), 1900)
        assert tuple(one(spark, w=w, h=h)) == expected
    assert [one(spark, p=g.padding_px(box(0, 0, n, n))).p for n in (40, 64, 90, 240)] == [0, 1, 2, 14]
    assert one(spark, v=g.js_round(F.lit(-2.5))).v == -2
    assert one(spark, v=g.rgba(F.lit("#ff8000"), F.lit(2.0))).v == "rgba(255, 128, 0, 1)"


def test_text(spark):
    assert one(spark, v=tx.utf16_length(F.lit("a😀"))).v == 3
    assert one(spark, v=tx.js_trim(F.lit("﻿　 a \n"))).v == "a"
    got = [one(spark, v=tx.js_number(F.lit(s))).v for s in ("", " 12 ", "0x10", "1e2", "x", "Infinity", "1e999", ".5", "-3.")]
    assert got == [0.0, 12.0, 16.0, 100.0, None, None, None, 0.5, -3.0]
    assert one(spark, v=tx.preview(F.lit("a  b\n" + "x" * 300))).v == "a b " + "x" * 235 + "…"
    assert one(spark, v=tx.truncate_note(F.lit("x" * 12), 10, "…")).v == "x" * 10 + "… [truncated 2 chars]"
    assert one(spark, v=tx.data_url(F.lit("a.JPG"), F.lit("x" * 300).cast("binary"))).v.count("\n") == 0
    names = [(k, n) for k, n in enumerate(["p10", "p2", "P02", "a1b2", "a1b10", "é1"])]
    df = spark.createDataFrame(names, "k int, n string")
    assert [r.n for r in df.orderBy(tx.natural_key(F.col("n")), "k").collect()] == ["a1b2", "a1b10", "é1", "p2", "P02", "p10"]
    names = [(k, n) for k, n in enumerate(["Ő2", "o10", "O1", "ő1", "ж2", "Ж10", "z1", "第2話", "第10話", "_1", "#1", "łz", "lz"])]
    df = spark.createDataFrame(names, "k int, n string")
    assert [r.n for r in df.orderBy(tx.natural_key(F.col("n")), "k").collect()] == ["_1", "#1", "łz", "lz", "O1", "ő1", "Ő2", "o10", "z1", "ж2", "Ж10", "第2話", "第10話"]
    rows = tx.with_search_text(spark.createDataFrame([("ＮＡＲＵＴＯ ",), (" Abc",), (None,)], "t string"), "t", "n").collect()
    assert {r.n for r in rows} == {"naruto", "abc", None}


def test_settings(spark):
    v = one(spark, a=lab.setting_int(F.lit("99"), 7, 0, 30), b=lab.setting_int(F.lit("x"), 7, 0, 30), c=lab.setting_effort(F.lit("minimal"), "medium"), d=lab.setting_bool(F.lit(" ON "), False), e=lab.setting_text(F.lit("  "), "base"))
    assert tuple(v) == (30, 7, "low", True, "base")


BROKEN = '''Sure.
\\`\\`\\`json
{ "items": [
  {"id": 1, "type": 'dialogue', "bbox": {"x": 10, "y": 20, "w": 30, "h": 40}, "jp": "あ", "ko": "가"},
  {id: 2, type: sfx, bbox: {a: 1, y: 2, w: 3, h: 4}, jp: い, ko: 나},
  {"id": 3, "type": "name",
    "x": 420, "y": 600, "w": 160, "h": 150 },
    "jp": "う", "ko: "다"},
  {"id": 4, "type": "sign", "bbox": {"x": 5, "y": 6, "w": 7, "h": 8}, "jp": "え", "ko": "라",},
] }
\\`\\`\\`'''
LINES = "id: 1\ntype: dialogue\nx: 1\ny: 2\nw: 3\nh: 4\njp: a\nko: b\n\nid: 2\ntype: sfx\nx: 5 y: 6 w: 7 h: 8\njp: [?]\nko: c [?]"


def read(spark, *texts, mode="fixed"):
    """(items as (type, x, y, w, h, jp, ko), error) of each reply."""
    df = spark.createDataFrame(list(enumerate(texts)), "reply_id int, text string")
    return [([tuple(i) for i in r["items"] or []], r.error) for r in rep.parsed(df, mode=mode).orderBy("reply_id").collect()]


#: Two replies with the breakages that models make: quotes that open before the key or never close, ids without quotes, a box without its key.
TORN = [
    """```json
{
  "items": [
    {
      "id": 1,
      "type": "dialogue",
      "bbox": { "x": 80, "y": 50, "w": 150, "h": 250 },
      "jp": "同じ、流れ？",
      "ko: 이거, 같은 흐름 아닌가?"
    },
    {
      "id": a,
      "type": "sign",
      "bbox": { "x": 420, "y": 600, "w: 160, h: 150 },
      "jp": "…どうか",
      "ko: ...어떤가"
    },
    {
      "id: c,
      "type": "dialogue",
       a: 430, y: 610, w: 170, h: 140 },
      "jp": "ないか？",
      "ko: 없고?"
    }
  ]
}
```""",
    """```json
{
  "items": [
    {
      "id": 1,
      "type": "dialogue",
      "bbox": { "x": 820, "y": 50, "w": 180, "h": 320 },
      "jp": "部屋…か",
      "ko: "방인가..."
    },
    {
      "id": 2,
      "bbox": { "x": 180, "y": 40, "w: 120, "h: 140 },
      "jp": "!",
      "ko: '!'
    },
    {
       a: 5,
      "type": "name",
      "bbox": { "x": 340, "y": 870, "w": 100, "h": 120 },
      "jp": "あ",
      "ko: "say \\"아\\"..."
    }
  ]
}
```""",
]


def test_broken_replies(spark):
    (a, error_a), (b, error_b), (c, error_c) = read(spark, *TORN, BROKEN)
    assert error_a is error_b is error_c is None
    assert a == [("dialogue", 80, 50, 150, 250, "同じ、流れ？", "이거, 같은 흐름 아닌가?"), ("sign", 420, 600, 160, 150, "…どうか", "...어떤가"), ("dialogue", 430, 610, 170, 140, "ないか？", "없고?")]
    assert b == [("dialogue", 820, 50, 180, 320, "部屋…か", "방인가..."), ("dialogue", 180, 40, 120, 140, "!", "!"), ("name", 340, 870, 100, 120, "あ", 'say "아"...')]
    assert [i[-1] for i in c] == ["가", "나", "다", "라"] and c[1] == ("sfx", 1, 2, 3, 4, "い", "나") and c[2][1:5] == (420, 600, 160, 150)


@pytest.mark.parametrize(("torn", "whole"), [
    ("[{'id': 1, 'x': 1, 'y': 2, 'w': 3, 'h': 4, 'ko': 'k'},]", ("dialogue", 1, 2, 3, 4, "", "k")),
    ('[{"id": 1, "x": "1", "y": 2, "w": 3, "h": 4, "korean": "k, l" "jp": "q"}', None),
    ('[{"left": 1, "top": 2, "width": 3, "height": 4, type: SFX, "korean": k}', ("SFX", 1, 2, 3, 4, "", "k")),
    ('{"blocks": [{"rect": {x1: 1, y1: 2, x2: 11, y2: 22}, "source": "s", "translation": "t",}]}', ("dialogue", 1, 2, 10, 20, "s", "t")),
    ('[{ID: 7, "Bbox": {"x": 1, "y": 2, "w": 3, "h": 4}, "KO": "k }, l"}', ("dialogue", 1, 2, 3, 4, "", "k }, l")),
    ('[{id: x, "x": 1, "y": 2, "w": 3, "h": 4, "ko": "k", "jp": "x: 9, y: 9"}', ("dialogue", 1, 2, 3, 4, "x: 9, y: 9", "k")),
    ('[{"x": 1, "y": 2, "w": 3, "h": NaN, "ko": "k"}]', None), ('[{"x": null, "left": 1, "y": 2, "w": 3, "h": 4, ko: k}]', ("dialogue", 1, 2, 3, 4, "", "k")),
])
def test_breakages(spark, torn, whole):
    (items, _), = read(spark, torn)
    assert whole is None and len(items) <= 1 or items == [whole]


def test_broken_reply_without_a_whole_item(spark):
    """What is JSON, if broken, is not read as lines, even if no item is whole."""
    torn = '{"items": [{\n"id": 1,\n"type": "sfx",\n"bbox": {"x": 1, "y": 2, "w": 3, "h": 4},\n"jp": "J",\n"ko: "\n},]}'
    assert read(spark, torn) == [([], None)]


def test_line_replies(spark):
    hurt = "id: 1\nx: 1\ny: 2\nw: 3\nh: 4\nko: say max: 3"
    texts = [LINES, "id: 1\nx: 1\ny: 2\nw: 3\nh: 4\n\nko: lost\n\nid: 2\nx: 1\ny: 2\nw: 3\nh: 4\nko: kept", "id: 1\nx: 1\ny: -2\nw: 3\nh: 4\nko: a", hurt, "x: 1 y: 2, w: 3 h: 4\r\n\"ko\": \"a\",\nid: 2\nbbox: {a: 5, y: 6, w: 7, h: 8}\nko: b\nko: c", "nothing", '{"ko": }', None]
    got = read(spark, *texts)
    assert [(i[0], i[-1]) for i in got[0][0]] == [("dialogue", "b"), ("sfx", "c [?]")]
    assert [i[-1] for i in got[1][0]] == ["kept"] and got[2][0] == [] and [i[-1] for i in got[3][0]] == ["say max: 3"]
    assert [(*i[1:5], i[-1]) for i in got[4][0]] == [(1, 2, 3, 4, "a"), (5, 6, 7, 8, "c")]
    assert [e for _, e in got[5:]] == [rep.NO_PAYLOAD, rep.NOT_JSON, rep.NO_PAYLOAD]
    compat = read(spark, LINES, hurt, mode="compat")
    assert compat[0][0] == [] and compat[1][0] == []  # the marks take over the slice; a coordinate beats the text


def test_replies_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, LINES)], "reply_id int, text string")
    for part in rep.parse_replies(df):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_parse_replies_routes(spark):
    texts = ["[]", '{"items": [{"korean": " k ", "rect": {"left": "1", "top": 2, "width": true, "height": "0x10"}}]}', '{"blocks": [{"ko": "k", "x1": 1, "y1": 2, "x2": 11, "y2": 22}, {"ko": "k", "x1": null}]}', '{"a": 1} xyz', '{"items": [1,]}', LINES, BROKEN, None, '{"items": [{"ko": "a", "x": 1, "y": 1, "w": 1, "h": 1, "ko": "b"}]}', "id: 1\ntype: dialogue\nx: 1\ny: 2\nw: 3\nh: 4\njp: q\nko: r"]
    df = spark.createDataFrame(list(enumerate(texts)), "reply_id int, text string")
    good, bad = rep.parse_replies(df)
    n = {}
    for r in good.collect():
        n.setdefault(r.reply_id, []).append((r.id, tuple(r.bbox), r.ko))
    assert n[1] == [(1, (1, 2, 1, 16), "k")] and n[2] == [(1, (1, 2, 10, 20), "k")] and len(n[5]) == 2 and len(n[6]) == 4
    assert [x[2] for x in n[8]] == ["b"] and n[9] == [(1, (1, 2, 3, 4), "r")]
    assert {r.reply_id for r in bad.collect()} == {3, 7}
    compat, _ = rep.parse_replies(df.where("reply_id = 5"), mode="compat")
    assert compat.count() == 0


def test_responses(spark):
    sse = 'event: a\ndata: {"type": "response.output_text.delta", "delta": "id: 1\\n"}\n\ndata: {"type": "response.output_text.delta", "delta": "ko: 테스트"}\n\ndata: {"type": "response.completed", "response": {"output": []}}\n\ndata: [DONE]\n\n'
    df = spark.createDataFrame([(1, sse), (2, 'data: {"type": "response.completed", "response": {"output": [{"content": [{"type": "output_text", "text": "late"}]}]}}\n\n'), (3, "data: oops\n\n")], "response_id int, body string")
    got = {r.response_id: r for r in rep.assemble_response(rep.parse_sse(df)).collect()}
    assert (got[1].text, got[1].n_events) == ("id: 1\nko: 테스트", 3) and got[2].text == "late" and set(got) == {1, 2}


def test_responses_streamed(spark, tmp_path):
    from folio.streaming.jobs import stream_assemble_response

    delta, end = 'data: {"type": "response.output_text.delta", "delta": "%s"}\n\n', 'data: {"type": "response.completed", "response": {%s}}\n\n'
    bodies = [
        (1, ": keep-alive\n\n" + delta % "a " + "data: oops\n\n" + delta % "b" + "data: [DONE]\n\n" + end % ""),
        (2, end % '"output_text": "late"'),
        (3, delta % "a" + 'data: {"type": "x", "output": [{"content": [{"text": " b "}]}, {"content": "c"}]}\n\n' + end % ""),
    ]
    events = rep.parse_sse(spark.createDataFrame(bodies, "response_id long, body string"))
    assert [r.pos for r in events.where("response_id = 1").orderBy("pos").collect()] == [0, 1, 2]
    events.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    out = stream_assemble_response(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    with state_store(spark):
        out.trigger(availableNow=True).start().awaitTermination(100)
    both = [{r.response_id: (r.text, r.n_events, r.error) for r in x.collect()} for x in (rep.assemble_response(events), spark.read.parquet(f"{tmp_path}/out"))]
    assert both[0] == both[1] == {1: ("a b", 3, None), 2: ("late", 1, None), 3: ("ab \nc", 3, None)}


def test_catalogue(spark):
    works = spark.createDataFrame([(1, "원피스", 0), (2, "NARUTO", 1)], "work_id int, title string, work_ord int")
    chapters = spark.createDataFrame([(1, 1, "1화", 0), (2, 1, "특별편", 1), (3, 2, "first", 0)], "chapter_id int, work_id int, title string, chapter_ord int")
    hit = lambda q: sorted((r.work_id, r.chapter_id) for r in cat.search_catalogue(works, chapters, q).collect())
    assert hit("원피") == [(1, 1), (1, 2)] and hit("특별") == [(1, 2)] and hit("naruto") == [(2, 3)] and hit("ninja") == [] and len(hit(" ")) == 3
    pages = spark.createDataFrame([(1, 1, 0, "a.png", "completed"), (2, 1, 1, "b.png", "idle")], "page_id int, chapter_id int, page_ord int, name string, analysis_status string").withColumn("last_error", F.lit(None).cast("string"))
    assert [r.page_id for r in cat.select_pages_for_run(pages, "pending").collect()] == [2]
    merged = cat.merge_live_local(pages, pages.withColumn("name", F.lit("mine")).withColumn("analysis_status", F.lit("completed")), spark.createDataFrame([(1,), (2,)], "page_id int"))
    assert {(r.page_id, r.name, r.kept_local) for r in merged.collect()} == {(1, "mine", True), (2, "b.png", False)}
    status = lambda *s: cat.chapter_status(chapters.limit(1), spark.createDataFrame([(1, x) for x in s], "chapter_id int, analysis_status string")).first().status
    assert [status("failed", "idle"), status("failed", "completed"), status("completed"), status("failed"), status("running", "failed")] == ["idle", "partial", "completed", "failed", "running"]
    r = one(spark, a=cat.reorder_ids(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (3, 3, 9, 1)))), m=cat.move_before_target(F.array(*map(F.lit, (1, 2, 3, 4))), F.lit(1), F.lit(3)), n=cat.move_before_target(F.array(*map(F.lit, (1, 2, 3, 4))), F.lit(4), F.lit(2)), u=cat.move_before_target(F.array(F.lit(1)), F.lit(9), F.lit(1)))
    assert (r.a, r.m, r.n, r.u) == ([3, 3, 1, 2], [2, 3, 1, 4], [1, 4, 2, 3], [1])
    new = spark.createDataFrame([(1, 10, "A", 1), (1, 11, "A (1)", 2), (1, 12, "A", 3)], "work_id int, chapter_id int, title string, arrival int")
    old = spark.createDataFrame([(1, "A")], "work_id int, title string")
    assert {r.chapter_id: r.title for r in cat.unique_titles(old, new).collect()} == {10: "A (1)", 11: "A (1) (1)", 12: "A (2)"}
    assert cat.unique_title(spark.createDataFrame([(1, "A"), (1, "A (1)"), (1, "A (3)")], "work_id int, title string"), old).first().title == "A (2)"


def test_jobs(spark):
    ev = spark.createDataFrame([(1, 1, "page_running", 21, 20), (1, 2, "page_running", None, None), (2, 1, "booting", None, None)], "job_id int, seq int, phase string, progress_current int, progress_total int")
    p = {r.job_id: r for r in jobs.progress(jobs.latest_job_state(ev)).collect()}
    assert (p[1].current, p[1].total, p[1].ratio) == (20, 20, 1.0) and p[2].mode == "indeterminate"
    assert jobs.status_feed(ev).where("job_id = 1").count() == 1
    w = spark.createDataFrame([(1, "x 건너뜁니다"), (1, "불확실한 OCR 1")], "job_id int, warning string")
    assert jobs.run_warnings(w).first().summary == lab.WARNING_BOTH
    assert one(spark, v=lab.classify_failure(F.lit("Gemma request failed: JSON parse failed"))).v == "model-request"
    a = spark.createDataFrame([(1, 1, False, "x"), (1, 2, True, None), *[(2, k, False, f"e{k}") for k in range(1, 6)]], "page_id int, attempt int, ok boolean, message string")
    assert {(r.page_id, r.status, r.last_error) for r in jobs.attempt_outcome(a).collect()} == {(1, "completed", None), (2, "failed", "e5")}


def test_layout(spark):
    row = Row(block_id="b", text="가", width=1000, height=1000, render_direction="horizontal", font_size_px=96.0, line_height=1.18, auto_fit_text=True)
    df = spark.createDataFrame([row]).withColumns({"bbox": box(0, 0, 40, 300), "render_bbox": F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")})
    r = layout.layout_qa(df, 1000, 1000).first()
    assert r.font_px <= 18 and not r.overflow
    v = layout.layout_qa(df.withColumn("render_direction", F.lit("vertical")), 1000, 1000).first()
    assert v.font_px >= 2 and not v.overflow
    assert layout.wrap("aa  bb", 2 * 0.95 * 10, 10) == [2, 2] and layout.wrap("", 10, 10) == [0]


def test_horizontal_fit_by_hand(spark):
    """Lines laid word by word, glyph by glyph, and every step of the bisection against them."""
    import random
    import re as regex

    def lines(text, width, font):
        per, out = max(1, math.floor(width / (0.95 * font) + 1e-9)), []
        for part in text.replace("\r", "").split("\n"):
            rest = regex.sub(r"\s+", " ", part).strip()
            out += [0] if not rest else []
            while rest:
                out.append(len(rest[:per].rstrip()))
                rest = rest[per:]
                rest = rest[1:] if rest[:1] == " " else rest
        return out

    def fits(text, font, w, h):
        laid = lines(text, w, font)
        return len(laid) * font * 1.18 <= h and max(laid) * 0.95 * font <= w + 1e-9

    rng, rows = random.Random(31), []
    for k in range(120):
        text = "".join(rng.choice("ab 가나 \n😀 ") for _ in range(rng.randrange(1, 60)))
        rows.append((str(k), text, float(rng.randrange(20, 600)), float(rng.randrange(20, 600))))
    df = spark.createDataFrame(rows, "block_id string, text string, w double, h double").withColumns({"bbox": g.bbox(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")), "render_bbox": F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"), "width": F.lit(1000), "height": F.lit(1000), "render_direction": F.lit("horizontal"), "font_size_px": F.lit(20.0), "line_height": F.lit(1.18), "auto_fit_text": F.lit(True)})
    for r in layout.layout_qa(df, 1000, 1000).collect():
        _, text, w, h = rows[int(r.block_id)]
        w, h = (max(1.0, max(1.0, v - r.padding * 2 - 2) - 20) for v in (w, h))
        cap = int(min(256, max(2, 20, w, h)))
        if not text.strip():
            assert (r.font_px, r.overflow) == (cap, False)
            continue
        lo, hi, best = 2, cap, 2
        while lo <= hi:
            mid = (lo + hi) // 2
            lo, hi, best = (mid + 1, hi, mid) if fits(text, mid, w, h) else (lo, mid - 1, best)
        assert (r.font_px, r.overflow) == (best, not fits(text, best, w, h))


def test_edits(spark):
    b = spark.createDataFrame([("x", 1, 1, "t", "horizontal")], "block_id string, page_id int, block_ord int, translated_text string, render_direction string").withColumns({"bbox": box(1, 2, 3, 4), "render_bbox": box(9, 9, 9, 9)})
    patch = spark.createDataFrame([("x", "new", "odd", 1)], "block_id string, translated_text string, render_direction string, patch_ord int").withColumn("bbox", box(990, 0, 50, 50))
    r = blk.edit_blocks(b, patch).first()
    assert (r.translated_text, r.render_direction, tuple(r.bbox), tuple(r.render_bbox)) == ("new", "horizontal", (1, 2, 3, 4), (990, 0, 10, 50))
    more = b.withColumns({"type": F.lit("speech"), "font_size_px": F.lit(20.0), "text_color": F.lit("#111111"), "opacity": F.lit(0.5)})
    patches = spark.createDataFrame([("x", "sfx", 31.0, None, 1), ("x", None, 30.0, "#00ff00", 2)], "block_id string, type string, font_size_px double, text_color string, patch_ord int")
    r = blk.edit_blocks(more, patches.withColumn("render_bbox", box(5, 5, 2000, 5))).first()
    assert (r.type, r.font_size_px, r.text_color, r.opacity, r.translated_text, tuple(r.bbox), tuple(r.render_bbox)) == ("sfx", 30.0, "#00ff00", 0.5, "t", (1, 2, 3, 4), (5, 5, 995, 5))
    twice = blk.duplicate_blocks(blk.duplicate_blocks(b, b), b)
    assert sorted(x.block_id for x in twice.collect()) == ["x", "x-copy-2", "x-copy-3"]


def test_titles_stay_unique(spark):
    """Families of titles, plain and numbered, against one title after the other."""
    import random

    rng = random.Random(32)
    names = ["A", "A (1)", "A (2)", "A (1) (1)", "B", "C", "C (7)", "(1)", ""]
    old = [(w, rng.choice(names)) for w in range(6) for _ in range(rng.randrange(4))]
    new = [(w, 100 * w + k, rng.choice(names), rng.randrange(5)) for w in range(6) for k in range(rng.randrange(9))]
    expected = {}
    for w in range(6):
        taken = {t for v, t in old if v == w}
        for _, c, t, _ in sorted((x for x in new if x[0] == w), key=lambda x: (x[3], x[1])):
            k, name = 1, t
            while name in taken:
                name, k = f"{t} ({k})", k + 1
            taken.add(name)
            expected[c] = name
    got = cat.unique_titles(spark.createDataFrame(old, "work_id int, title string"), spark.createDataFrame(new, "work_id int, chapter_id int, title string, arrival int"))
    assert {r.chapter_id: r.title for r in got.collect()} == expected
    chapters = spark.createDataFrame([(1, 1, "A"), (2, 1, "B"), (3, 1, "C"), (4, 2, "A")], "chapter_id int, work_id int, title string")
    patches = spark.createDataFrame([(2, " A ", 1), (3, "A", 2), (3, "x/y", 0)], "chapter_id int, title string, patch_ord int")
    out = cat.rename(chapters, patches, "chapter_id", "Untitled", "work_id")
    assert {r.chapter_id: r.title for r in out.collect()} == {1: "A", 2: "A (1)", 3: "A (2)", 4: "A"} and out.columns == chapters.columns


def test_whole_pages_merge(spark):
    live = spark.createDataFrame([(1, "a", 10, "completed", "e1"), (2, "b", 10, "completed", None), (3, "c", 10, "running", None)], "page_id int, name string, width int, analysis_status string, last_error string")
    local = spark.createDataFrame([(1, "mine", 99, "completed", "old"), (2, "mine", 99, "failed", None), (3, "mine", 99, "completed", None)], live.schema)
    merged = cat.merge_live_local(live, local, spark.createDataFrame([(1,), (2,), (3,)], "page_id int"))
    assert {tuple(r) for r in merged.collect()} == {(1, "mine", 99, "completed", "e1", True), (2, "b", 10, "completed", None, False), (3, "c", 10, "running", None, False)}
    blocks = lambda t: spark.createDataFrame([(k, t) for k in (1, 2, 3)], "page_id int, text string")
    assert {tuple(r) for r in cat.merge_live_local_blocks(blocks("live"), blocks("local"), merged).collect()} == {(1, "local"), (2, "live"), (3, "live")}


def test_feed_takes_late_events(spark, tmp_path):
    """Events that cross micro-batches out of order, against the batch twin."""
    import random

    from folio.streaming.jobs import stream_status_feed

    rng = random.Random(33)
    rows = [(j, k, rng.choice(["booting", "page_running", "page_done", "page_retry"])) for j in range(5) for k in range(60)]
    rng.shuffle(rows)
    schema = "job_id long, seq int, phase string"
    for n in range(6):
        spark.createDataFrame(rows[n::6], schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    with state_store(spark):
        source = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        keep = lambda batch, n: batch.write.parquet(f"{tmp_path}/out/batch={n}")
        stream_status_feed(source).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    out = out.join(out.groupBy("job_id").agg(F.max("batch").alias("batch")), ["job_id", "batch"])
    twin = jobs.status_feed(spark.createDataFrame(rows, schema))
    names = [c for c in ("job_id", "seq", "label") if c in twin.columns]
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(map(tuple, twin.select(*names).collect()))


def test_edits_wait_for_jobs(spark):
    from folio.streaming.jobs import coalesce_edits

    at = lambda s: F.timestamp_seconds(s)
    edits = spark.createDataFrame([(1, 10, 1, "a"), (1, 20, 2, "b"), (1, 25, 3, "c"), (1, 60, 4, "d"), (2, 22, 5, "x")], "chapter_id int, s int, version int, snapshot string").withColumn("ts", at("s"))
    spans = spark.createDataFrame([(1, 15, 59)], "chapter_id int, a int, b int").select("chapter_id", at("a").alias("started"), at("b").alias("ended"))
    got = {(r.chapter_id, r.burst_start.timestamp(), r.snapshot, r.edits) for r in coalesce_edits(edits, "2 seconds", spans).collect()}
    assert got == {(1, 10.0, "a", 1), (1, 59.0, "d", 3), (2, 22.0, "x", 1)}


def test_imports(spark):
    t = spark.createDataFrame([(1, " ", None), (2, "T", None), (3, "", 5), (4, "T", None)], "import_id int, new_title string, work_id int")
    s = spark.createDataFrame([(1, "a", True), (2, " ", True), (2, "b", False), (3, "c", True), (4, "d", True)], "import_id int, title string, enabled boolean")
    assert {r.import_id: r.valid for r in imp.valid_imports(s, t).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_first_text_is_not_followed_by_a_search_for_others(spark):
    late = F.raise_error(F.lit("looked for")).cast("string")
    assert one(spark, v=rep._first(F.lit(None).cast("string"), F.lit(" "), F.lit("a"), late)).v == "a"


def test_broken_items_by_other_names_and_corners(spark):
    text = """{"items": [{"id: 1, korean: "k", "source": "s", "rect": {"left": 1, "top": 2, "width": 3, "height": 4}},
{id: 2, "ko": " ", "text_ko": "t", "box": {"x1": 10, "y1": 20, "x2": 15, "y2": 26}}, {id: 3, "ko": "u", "y": 2, "x2": 9, "w": null, "x": 4, "h": 5, "y1": 1, "x1": 4, "y2": 3}],}"""
    rows = rep.parse_replies(spark.createDataFrame([(1, text)], "reply_id int, text string"))[0].orderBy("id").collect()
    assert [(r.ko, r.jp, tuple(r.bbox)) for r in rows] == [("k", "s", (1, 2, 3, 4)), ("t", "", (10, 20, 5, 6)), ("u", "", (4, 2, 5, 5))]


def test_lines_of_a_text_without_spaces_are_counted_unwrapped(monkeypatch):
    from folio.operators import layout

    rng, cases = random.Random(1), []
    for _ in range(300):
        text = "".join(rng.choice("ab가나😀") for _ in range(rng.randrange(1, 40)))
        cases.append((text, rng.randrange(2, 60), rng.uniform(1, 300), rng.uniform(1, 300), 1.18))
    wrapped = [layout._fits(*c) for c in cases]
    monkeypatch.delattr(layout, "wrap")
    assert [layout._fits(*c, len(c[0])) for c in cases] == wrapped and len(set(wrapped)) == 2
