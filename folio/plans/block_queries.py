"""Registered queries over reply parsing, blocks, geometry and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import geometry as g
from folio.functions import labels as lab
from folio.functions import text as tx
from folio.operators import blocks as blk
from folio.operators import imports as imp
from folio.operators import layout
from folio.operators import replies as rep
from folio.operators.catalogue import chapter_status
from folio.plans.spec import query

_ITEMS = "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY item_ord) AS id, type, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, jp, ko FROM b_items WHERE ko <> ''"
_ITEM_COLS = "page_id bigint, id bigint, type string, x double, y double, w double, h double, jp string, ko string"
_CLAMP = "least(1000.0, greatest(0.0, x)) AS bx, least(1000.0, greatest(0.0, y)) AS by_, least(1000.0 - least(1000.0, greatest(0.0, x)), greatest(1.0, w)) AS bw, least(1000.0 - least(1000.0, greatest(0.0, y)), greatest(1.0, h)) AS bh"
_TYPE = "CASE type WHEN 'dialogue' THEN 'speech' WHEN 'narration' THEN 'caption' WHEN 'name' THEN 'caption' WHEN 'sfx' THEN 'sfx' ELSE 'other' END"
_BLOCKS = f"SELECT i.page_id, i.id, {_TYPE} AS type, i.jp, i.ko, s.width, s.height, {_CLAMP} FROM ({_ITEMS}) i JOIN b_sizes s ON s.page_id = i.page_id"
_FONT = "least(72, greatest(12, least(least(floor(bh / 1000 * height / (ln * 1.2)), floor(bw / 1000 * width / least(12, greatest(4, n)))), 40)))"
_FONTED = f"SELECT *, {_FONT} AS font FROM (SELECT *, greatest(1, ceil(n / greatest(4, floor(bw / 1000 * width / 20)))) AS ln FROM (SELECT *, greatest(1, length(ko)) AS n FROM ({_BLOCKS}) b1) b2) b3"


def _flat(df):
    return df.select("*", *[F.col(f"bbox.{k}").alias(k) for k in "xywh"])


def _records(b):
    return rep.parse_replies(rep.render_line_replies(b.b_items), "page_id")[0]


def _broken_item(page: str = "page_id"):
    """An item's JSON, broken: half-quoted keys, bare keys and texts, a box without key, half-quoted sides, an odd x and commas, torn lines."""
    f = lambda form: F.format_string(form, *[F.col(c) for c in ("item_ord", "type", "x", "y", "w", "h", "jp", "ko")])
    forms = [
        """{"id: %s, "type": '%s', "bbox": {"x": %s, "y": %s, "w": %s, "h": %s}, "jp": "%s", "ko": "%s"}""",
        "{id: %s, type: %s, bbox: {x: %s, y: %s, w: %s, h: %s}, jp: %s, ko: %s}",
        """{"id": i%s, "type": "%s",\n"x": %s, "y": %s, "w": %s, "h": %s },\n"jp": "%s",\n"ko": "%s"}""",
        """{"id": %s, 'type': '%s', "bbox": { "x": %s, "y": %s, "w: %s, "h: %s }, "jp": '%s', "ko: "%s"}""",
        """{"id": %s, "type": "%s", "bbox": {a: %s, "y": %s, "w": %s, "h": %s,}, "jp": "%s", "ko": "%s",}""",
        """{\n"id": %s,\n"type": "%s",\n"bbox": {"x": %s, "y": %s, "w": %s, "h": %s},\n"jp": "%s",\n"ko: %s"\n}""",
    ]
    out = f(forms[0])
    for k, form in enumerate(forms[1:], 1):
        out = F.when((F.col(page) + F.col("item_ord")) % len(forms) == k, f(form)).otherwise(out)
    return out


def _json_replies(b, route: str):
    """JSON replies of every page's items in one form: plain, fenced with a trailing comma, or broken in several ways."""
    form = """{"id": %s, "type": "%s", "bbox": {"x": %s, "y": %s, "w": %s, "h": %s}, "jp": "%s", "ko": "%s"}"""
    item = _broken_item() if route == "broken" else F.format_string(form, *[F.col(c) for c in ("item_ord", "type", "x", "y", "w", "h", "jp", "ko")])
    rows = b.b_items.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_ord", item.alias("t")))), lambda x: x["t"]), ",\n").alias("t"))
    wrap = {"plain": F.concat(F.lit('{"items": ['), F.col("t"), F.lit("]}")), "comma": F.concat(F.lit("Sure:\n```json\n["), F.col("t"), F.lit(",]\n```\n")), "broken": F.concat(F.lit('{"items": ['), F.col("t"), F.lit(",]}"))}
    return rows.select("page_id", wrap[route].alias("text"))


@query("part_id bigint, payload string", """SELECT p_partkey AS part_id, CASE p_partkey % 5 WHEN 0 THEN '{"id":' || CAST(p_partkey AS VARCHAR) || '}' WHEN 1 THEN '{"id":' || CAST(p_partkey AS VARCHAR) || '}' WHEN 2 THEN '{"id":' || CAST(p_partkey AS VARCHAR) || '}' WHEN 3 THEN '[1, ' || CAST(p_partkey AS VARCHAR) || ']' END AS payload FROM part""")
def c1_extract_payload(b):
    rows = b("SELECT p_partkey AS part_id, concat('{\"id\":', CAST(p_partkey AS STRING), '}') AS j, concat('[1, ', CAST(p_partkey AS STRING), ']') AS a, p_partkey % 5 AS k FROM part")
    text = F.when(F.col("k") == 0, F.concat(F.lit("  "), "j")).when(F.col("k") == 1, F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n```\nbye {"))).when(F.col("k") == 2, F.concat(F.lit("so "), "j", F.lit(" is it"))).when(F.col("k") == 3, F.concat(F.lit("list "), "a", F.lit("."))).otherwise("none")
    return rows.select("part_id", rep.extract_payload(text).alias("payload"))


@query("part_id bigint, id bigint", "SELECT p_partkey AS part_id, CASE WHEN p_partkey % 4 < 2 THEN p_partkey END AS id FROM part")
def c2_parse_json_strict(b):
    rows = b("SELECT p_partkey AS part_id, p_partkey % 4 AS k, concat('{\"id\":', CAST(p_partkey AS STRING)) AS j FROM part")
    text = F.when(F.col("k") == 0, F.concat("j", F.lit("}"))).when(F.col("k") == 1, F.concat("j", F.lit(", }"))).when(F.col("k") == 2, F.concat("j", F.lit("} xyz"))).otherwise("j")
    return rows.select("part_id", F.try_variant_get(rep.parse_json_strict(text), "$.id", "bigint").alias("id"))


@query(_ITEM_COLS, _ITEMS)
def c3_repair_json(b):
    """All pages; the items of a reply are broken in six ways, each by its number."""
    return _flat(rep.parse_replies(_json_replies(b, "broken"), "page_id")[0])


@query(_ITEM_COLS, _ITEMS)
def c4_line_records(b):
    return _flat(_records(b))


@query(_ITEM_COLS, _ITEMS)
def c5_normalize_items(b):
    return _flat(rep.parse_replies(_json_replies(b, "plain"), "page_id")[0])


@query(_ITEM_COLS, f"SELECT * FROM ({_ITEMS}) i")
def c6_parse_replies(b):
    """Every form of reply in one table, by page: clean JSON, fenced with trailing commas, and broken."""
    plain, comma, broken = [_json_replies(b, route).where(f"page_id % 3 = {k}") for k, route in enumerate(("plain", "comma", "broken"))]
    texts = plain.unionByName(comma).unionByName(broken)
    return _flat(rep.parse_replies(texts, "page_id")[0])


@query("page_id bigint, error string", "SELECT DISTINCT page_id, 'Failed to find a parseable structured payload in the model output.' AS error FROM b_items")
def c6_parse_errors(b):
    return rep.parse_replies(b("SELECT DISTINCT page_id, 'no answer here' AS text FROM b_items"), "page_id")[1]


@query("conv_id bigint, turn bigint, answer string", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN trim(text) || chr(10) || role ELSE trim(text) END AS answer FROM conversations")
def c7_response_text(b):
    rows = b("SELECT conv_id, turn, role, text FROM conversations")
    a = F.to_json(F.struct(F.col("text").alias("output_text")))
    c = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    o = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("output_text").alias("type"), F.col("text")), F.struct(F.lit("output_text").alias("type"), F.col("role").alias("text"))).alias("content"))).alias("output")))
    return rows.select("conv_id", "turn", rep.response_text(F.when(F.col("turn") % 3 == 0, a).when(F.col("turn") % 3 == 1, c).otherwise(o)).alias("answer"))


def _sse(b):
    part = F.concat(F.lit("event: x\ndata: "), F.to_json(F.struct(F.lit("response.output_text.delta").alias("type"), F.col("text").alias("delta"))), F.lit("\n\n"))
    rows = b("SELECT conv_id, turn, text FROM conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "").alias("body"))
    return rows.select(F.col("conv_id").alias("response_id"), F.concat("body", F.lit('data: {"type": "response.completed", "response": {}}\n\ndata: not json\n\ndata: [DONE]\n\n')).alias("body"))


@query("response_id bigint, pos bigint, type string, delta string", "SELECT conv_id AS response_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 'response.output_text.delta' AS type, text AS delta FROM conversations UNION ALL SELECT conv_id, count(*), 'response.completed', NULL FROM conversations GROUP BY conv_id")
def a7_parse_sse(b):
    return rep.parse_sse(_sse(b))


@query("response_id bigint, text string, n_events bigint", "SELECT conv_id AS response_id, trim(string_agg(text, '' ORDER BY turn)) AS text, count(*) + 1 AS n_events FROM conversations GROUP BY 1")
def c8_assemble_response(b):
    return rep.assemble_response(rep.parse_sse(_sse(b)))


@query("block_id string, page_id bigint, type string, x double, y double, w double, h double, source_text string, translated_text string, confidence double, font_size_px double, background_color string, opacity double",
       f"SELECT CAST(page_id AS VARCHAR) || '-block-' || CAST(id AS VARCHAR) AS block_id, page_id, type, bx AS x, by_ AS y, bw AS w, bh AS h, jp AS source_text, ko AS translated_text, CASE WHEN jp <> '' THEN 0.92 ELSE 0.75 END AS confidence, font AS font_size_px, CASE type WHEN 'sfx' THEN '#fff4ea' ELSE '#fffdf5' END AS background_color, CASE type WHEN 'sfx' THEN 0.7 ELSE 0.88 END AS opacity FROM ({_FONTED}) f")
def d1_items_to_blocks(b):
    return _flat(blk.items_to_blocks(_records(b), b.b_sizes))


@query("page_id bigint, item_ord bigint, kind string", f"SELECT page_id, item_ord, {_TYPE} AS kind FROM b_items")
def d2_block_type(b):
    return b.b_items.select("page_id", "item_ord", lab.block_type(F.concat(F.lit(" "), F.upper("type"))).alias("kind"))


@query("event_id bigint, src string, ren string, al string, col string", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'horizontal' ELSE 'vertical' END AS src, CASE event_id % 4 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'rotated' WHEN 2 THEN 'hidden' ELSE 'horizontal' END AS ren, CASE event_id % 4 WHEN 3 THEN 'left' ELSE 'center' END AS al, CASE WHEN event_id % 2 = 0 THEN '#00aaFF' ELSE '#111111' END AS col FROM events")
def d3_normalisers(b):
    rows = b("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' Horizontal ' WHEN 1 THEN 'ROTATED' WHEN 2 THEN 'hidden' ELSE 'left' END AS v, CASE WHEN event_id % 2 = 0 THEN ' #00aaFF' ELSE '#12345' END AS c FROM events")
    return rows.select("event_id", lab.source_direction(F.col("v")).alias("src"), lab.render_direction(F.col("v")).alias("ren"), lab.text_align(F.col("v")).alias("al"), lab.color(F.col("c"), "#111111").alias("col"))


@query("block_id string, display_text string", "SELECT CAST(page_id AS VARCHAR) || '-' || CAST(item_ord AS VARCHAR) AS block_id, CASE WHEN ko <> '' THEN ko WHEN jp <> '' THEN jp ELSE '...' END AS display_text FROM b_items WHERE item_ord % 3 <> 0")
def d5_display_text(b):
    return blk.visible_text(b("SELECT concat(CAST(page_id AS STRING), '-', CAST(item_ord AS STRING)) AS block_id, ko AS translated_text, jp AS source_text, CASE WHEN item_ord % 3 = 0 THEN 'hidden' ELSE 'horizontal' END AS render_direction FROM b_items"))


@query("event_id bigint, n bigint, flag boolean, effort string, name string", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(30, event_id % 100) WHEN 1 THEN 0 WHEN 2 THEN 7 ELSE 7 END AS n, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS flag, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'xhigh' ELSE 'medium' END AS effort, CASE event_type WHEN 'view' THEN 'base' ELSE event_type END AS name FROM events""")
def d6_clean_settings(b):
    rows = b("SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(' ', CAST(event_id % 100 AS STRING)) WHEN 1 THEN '-5' WHEN 2 THEN '1.5' ELSE 'many' END AS n, CASE event_id % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN 'OFF' ELSE 'maybe' END AS f, CASE event_id % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'xhigh' ELSE 'huge' END AS e, CASE event_type WHEN 'view' THEN '  ' ELSE concat(event_type, ' ') END AS m FROM events")
    return rows.select("event_id", lab.setting_int(F.col("n"), 7, 0, 30).alias("n"), lab.setting_bool(F.col("f"), True).alias("flag"), lab.setting_effort(F.col("e"), "medium").alias("effort"), lab.setting_text(F.col("m"), "base").alias("name"))


@query("page_id bigint, item_ord bigint", "SELECT page_id, item_ord FROM b_items WHERE contains(jp, '[?]') OR contains(ko, '[?]')")
def e6_uncertain_items(b):
    return blk.uncertain_items(b.b_items)


@query("page_id bigint, uncertain_count bigint", "SELECT page_id, count(*) AS uncertain_count FROM b_items WHERE contains(jp, '[?]') GROUP BY 1")
def g3_page_warnings(b):
    return blk.page_warnings(b.b_items)


@query("page_id bigint, json string", """SELECT page_id, '{"items":[' || string_agg('{"id":' || CAST(id AS VARCHAR) || ',"type":"' || type || '","bbox":{"x":' || CAST(x AS VARCHAR) || ',"y":' || CAST(y AS VARCHAR) || ',"w":' || CAST(w AS VARCHAR) || ',"h":' || CAST(h AS VARCHAR) || '},"jp":"' || jp || '","ko":"' || ko || '"}', ',' ORDER BY id) || ']}' AS json FROM (""" + _ITEMS + """) i GROUP BY 1""")
def b2_overlay_documents(b):
    from folio.sources.attempts import overlay_documents

    return overlay_documents(_records(b))


_SAID = "CASE WHEN page_ord > 1 THEN 'again' ELSE 'first' END"
_CHAT = """[{"role":"system","content":[{"type":"text","text":"sys"}]},{"role":"user","content":[{"type":"text","text":"Image 1: the original full manga page."},{"type":"image_url","image_url":{"url":"' || name || '"}},{"type":"text","text":"Image 2: the same full manga page rendered as grayscale/high-contrast assist view."},{"type":"image_url","image_url":{"url":"gray-' || name || '"}},{"type":"text","text":"' || """ + _SAID + """ || '"}]}]"""


def _request(b, **options):
    images = F.array(*[F.struct(F.lit(role).alias("role"), F.concat(F.lit(before), "name").alias("uri")) for role, before in (("original", ""), ("enhanced", "gray-"))])
    lit = F.lit
    return b.b_pages.select("page_id", imp.request_body(lit("sys"), lit("first"), lit("again"), imp.image_labels(images), F.col("page_ord"), lit("m"), lit(900), **options).alias("body"))


@query("page_id bigint, body string", """SELECT page_id, '{"model":"m","temperature":0.2,"top_p":0.9,"top_k":40,"presence_penalty":0,"frequency_penalty":0,"max_tokens":900,"reasoning_budget":0,"enable_thinking":false,"messages":""" + _CHAT + """}' AS body FROM b_pages""")
def b3_requests(b):
    return _request(b, sampling={"temperature": F.lit(0.2), "top_p": F.lit(0.9), "top_k": F.lit(40)})


@query("page_id bigint, body string", """SELECT page_id, '{"model":"m","max_tokens":900,"reasoning_effort":"' || CASE WHEN width > 1000 THEN 'high' ELSE 'low' END || '","messages":""" + _CHAT + """}' AS body FROM b_pages""")
def b3_requests_hosted(b):
    return _request(b, hosted=True, effort=F.when(F.col("width") > 1000, "high").otherwise("low"))


@query("page_id bigint, body string", """SELECT page_id, '{"model":"m","instructions":"sys","input":[{"role":"user","content":[{"type":"input_text","text":"Image 1: the original full manga page."},{"type":"input_image","image_url":"' || name || '"},{"type":"input_text","text":"Image 2: the same full manga page rendered as grayscale/high-contrast assist view."},{"type":"input_image","image_url":"gray-' || name || '"},{"type":"input_text","text":"' || """ + _SAID + """ || '"}]}],"reasoning":{"effort":"low"},"stream":true,"store":false}' AS body FROM b_pages""")
def b3_responses_requests(b):
    return _request(b, kind="responses", effort=F.lit("low"))


@query("block_id string, x double, y double, w double, h double, translated_text string, type string, font_size_px double, text_color string", """SELECT CAST(page_id AS VARCHAR) || '-' || CAST(id AS VARCHAR) || CASE WHEN sfx = '' THEN '' ELSE '-copy-' || CAST(last + place AS VARCHAR) END AS block_id, CASE WHEN sfx = '' THEN bx ELSE least(1000.0, bx + 16) END AS x, CASE WHEN sfx = '' THEN by_ ELSE least(1000.0, by_ + 16) END AS y, CASE WHEN sfx = '' THEN bw ELSE least(1000.0 - least(1000.0, bx + 16), greatest(1.0, bw)) END AS w, CASE WHEN sfx = '' THEN bh ELSE least(1000.0 - least(1000.0, by_ + 16), greatest(1.0, bh)) END AS h, CASE WHEN id % 2 = 0 THEN 'edited' ELSE ko END AS translated_text, CASE WHEN id % 2 = 0 THEN 'sfx' ELSE type END AS type, CASE WHEN id % 4 = 0 THEN 30.0 WHEN id % 2 = 0 THEN 31.0 ELSE 20.0 END AS font_size_px, CASE WHEN id % 2 = 0 THEN '#00ff00' ELSE '#111111' END AS text_color
FROM (SELECT e.*, s.sfx, max(id) OVER (PARTITION BY page_id) AS last, row_number() OVER (PARTITION BY page_id, sfx ORDER BY id) AS place FROM (SELECT i.page_id, i.id, i.ko, i.type, """ + _CLAMP + """ FROM (SELECT page_id, id, ko, type, CASE WHEN id % 2 = 0 THEN 100.0 ELSE x END AS x, CASE WHEN id % 2 = 0 THEN 200.0 ELSE y END AS y, CASE WHEN id % 2 = 0 THEN 2000.0 ELSE w END AS w, CASE WHEN id % 2 = 0 THEN 50.0 ELSE h END AS h FROM (""" + _ITEMS + """) i0 WHERE id % 5 <> 0) i) e CROSS JOIN (SELECT '' AS sfx UNION ALL SELECT '-copy') s WHERE s.sfx = '' OR e.id % 3 = 0) z""")
def f12_edit_blocks(b):
    """Even blocks are edited, every fifth is deleted, every third of the rest duplicated."""
    i = b(_ITEMS.replace("row_number() OVER", "CAST(row_number() OVER").replace("ORDER BY item_ord) AS id", "ORDER BY item_ord) AS INT) AS id"))
    box = g.clamp_bbox(g.bbox(*[F.col(k) for k in "xywh"]))
    rows = i.select("page_id", F.col("id").alias("block_ord"), F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("id").cast("string")).alias("block_id"), F.col("ko").alias("translated_text"), F.lit("horizontal").alias("render_direction"), box.alias("bbox"), F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("render_bbox"), "type", F.lit(20.0).alias("font_size_px"), F.lit("#111111").alias("text_color"))
    even = rows.where("block_ord % 2 = 0")
    patch = even.select("block_id", F.lit("edited").alias("translated_text"), F.lit(None).cast("string").alias("render_direction"), g.bbox(*[F.lit(v) for v in (100, 200, 2000, 50)]).alias("bbox"), F.lit("sfx").alias("type"), F.lit(31.0).alias("font_size_px"), F.lit("#00ff00").alias("text_color"), F.lit(1).alias("patch_ord"))
    patch = patch.unionByName(even.where("block_ord % 4 = 0").select("block_id", F.lit(30.0).alias("font_size_px"), F.lit(2).alias("patch_ord")), allowMissingColumns=True)
    out = blk.delete_blocks(blk.edit_blocks(rows, patch), rows.where("block_ord % 5 = 0"))
    return _flat(blk.duplicate_blocks(out, out.where("block_ord % 3 = 0")))


@query("page_id bigint, item_ord bigint, k1 double, x double, y double, w double, h double", "SELECT page_id, item_ord, least(500.0, greatest(10.0, CAST(x AS DOUBLE))) AS k1, bx AS x, by_ AS y, bw AS w, bh AS h FROM (SELECT *, " + _CLAMP.replace("x)", "CAST(x AS DOUBLE))").replace(", y)", ", CAST(y AS DOUBLE))").replace("greatest(1.0, w)", "greatest(1.0, CAST(w AS DOUBLE))").replace("greatest(1.0, h)", "greatest(1.0, CAST(h AS DOUBLE))") + " FROM b_items) q1")
def k1_k2_clamp(b):
    v = [F.col(c).cast("double") for c in "xywh"]
    return _flat(b.b_items.select("page_id", "item_ord", g.clamp(v[0], 10.0, 500.0).alias("k1"), g.clamp_bbox(g.bbox(*v)).alias("bbox")))


_PX = f"SELECT page_id, id, ko, jp, type, bx, by_, bw, bh, width, height, bx / 1000 * width AS px, by_ / 1000 * height AS py, bw / 1000 * width AS pw, bh / 1000 * height AS ph FROM ({_BLOCKS}) b1"


def _boxes(b):
    i = b(_ITEMS).select("page_id", "id", "jp", "ko", "type", g.clamp_bbox(g.bbox(*[F.col(k) for k in "xywh"])).alias("bbox"))
    return i.join(b.b_sizes, "page_id")


@query("page_id bigint, id bigint, px double, pw double, back_x double, back_w double", f"SELECT page_id, id, px, pw, bx AS back_x, CASE WHEN bw < 1 AND bx < 1000 THEN 1.0 ELSE bw END AS back_w FROM ({_PX}) p")
def k3_pixels(b):
    px = g.bbox_to_pixels(F.col("bbox"), F.col("width"), F.col("height"))
    back = g.pixels_to_bbox(px, F.col("width"), F.col("height"))
    return _boxes(b).select("page_id", "id", px["x"].alias("px"), px["w"].alias("pw"), back["x"].alias("back_x"), back["w"].alias("back_w"))


@query("page_id bigint, id bigint, rx double, source_x double, layout_x double", f"SELECT page_id, id, CASE WHEN id % 2 = 0 THEN 80.0 ELSE bx END AS rx, CASE WHEN id % 2 = 0 THEN bx ELSE 120.0 END AS source_x, CASE WHEN id % 2 = 0 THEN 120.0 END AS layout_x FROM ({_BLOCKS}) p")
def k4_layout_boxes(b):
    rows = _boxes(b).withColumn("lay", F.when(F.col("id") % 2 == 0, g.bbox(*[F.lit(v) for v in (80, 90, 220, 260)])))
    s, l = g.apply_bbox_edit(F.col("bbox"), F.col("lay"), g.bbox(*[F.lit(v) for v in (120, 140, 240, 280)]))
    return rows.select("page_id", "id", g.render_bbox(F.col("bbox"), F.col("lay"))["x"].alias("rx"), s["x"].alias("source_x"), l["x"].alias("layout_x"))


@query("page_id bigint, id bigint, x double, w double", f"SELECT page_id, id, least(1000.0, bx + 16) AS x, least(1000.0 - least(1000.0, bx + 16), greatest(1.0, bw)) AS w FROM ({_BLOCKS}) p")
def k5_offset_bboxes(b):
    o = g.offset_bbox(F.col("bbox"), F.lit(16.0), F.lit(16.0))
    return _boxes(b).select("page_id", "id", o["x"].alias("x"), o["w"].alias("w"))


@query("page_id bigint, id bigint, x double, h double", f"SELECT page_id, id, CASE WHEN id % 2 = 0 THEN least(1000.0, bx + 50) ELSE bx END AS x, CASE WHEN id % 2 = 0 THEN least(1000.0 - least(1000.0, by_ + 25), greatest(1.0, bh)) ELSE least(1000.0 - by_, greatest(1.0, bh + 25)) END AS h FROM ({_BLOCKS}) p")
def k6_drag(b):
    d = g.drag_bbox(F.col("bbox"), F.when(F.col("id") % 2 == 0, "move").otherwise("resize"), F.lit(40.0), F.lit(30.0), F.lit(800.0), F.lit(1200.0))
    return _boxes(b).select("page_id", "id", d["x"].alias("x"), d["h"].alias("h"))


@query("page_id bigint, id bigint, font double", f"SELECT page_id, id, font FROM ({_FONTED}) f")
def k7_estimate_font(b):
    return _boxes(b).select("page_id", "id", g.estimate_font_px(F.col("ko"), F.col("bbox"), F.col("width"), F.col("height")).alias("font"))


@query("page_id bigint, w bigint, h bigint", "SELECT page_id, greatest(1, floor(width * least(1.0, 1000.0 / greatest(width, height)) + 0.5)) AS w, greatest(1, floor(height * least(1.0, 1000.0 / greatest(width, height)) + 0.5)) AS h FROM b_pages")
def k8_scaled_size(b):
    w, h = g.scaled_size(F.col("width"), F.col("height"), 1000)
    return b.b_pages.select("page_id", w.alias("w"), h.alias("h"))


_RECT = f"SELECT *, pw * (800.0 / width) AS rw, ph * (1200.0 / height) AS rh, px * (800.0 / width) AS rx FROM ({_PX}) p0"
_PAD = "CASE WHEN least(rw, rh) <= 48 THEN 0 WHEN least(rw, rh) <= 72 THEN 1 WHEN least(rw, rh) <= 96 THEN 2 ELSE floor(least(14.0, greatest(3.0, least(rw, rh) * 0.06)) + 0.5) END"


@query("page_id bigint, id bigint, rx double, rw double, rh double, padding bigint", f"SELECT page_id, id, rx, rw, rh, {_PAD} AS padding FROM ({_RECT}) r")
def k9_k10_rect_padding(b):
    r = g.block_rect(F.col("bbox"), F.col("width"), F.col("height"), F.lit(800.0), F.lit(1200.0))
    return _boxes(b).select("page_id", "id", r["x"].alias("rx"), r["w"].alias("rw"), r["h"].alias("rh"), g.padding_px(r).alias("padding"))


@query("page_id bigint, id bigint, cols bigint, fits boolean", f"SELECT page_id, id, greatest(1, ceil(length(ko) / greatest(1, floor(ph / 20.0)))) AS cols, greatest(1, ceil(length(ko) / greatest(1, floor(ph / 20.0)))) * (16 * 1.15) <= pw AS fits FROM ({_PX}) p")
def k11_vertical_fit(b):
    px = g.bbox_to_pixels(F.col("bbox"), F.col("width"), F.col("height"))
    n, font, line = tx.utf16_length(F.col("ko")), F.lit(16.0), F.lit(20.0)
    return _boxes(b).select("page_id", "id", g.vertical_columns(n, font, line, px["h"]).alias("cols"), g.vertical_fits(n, font, line, px["w"], px["h"]).alias("fits"))


_QA = f"SELECT *, greatest(1.0, greatest(1.0, rw - pad * 2 - 2) - 20) AS iw, greatest(1.0, greatest(1.0, rh - pad * 2 - 2) - 20) AS ih FROM (SELECT *, {_PAD} AS pad FROM ({_RECT}) r) r2"
def _fits_vertical(f: str) -> str:
    return f"greatest(1, ceil(length(ko) / greatest(1, floor(ih / greatest({f}, {f} * 1.18e0))))) * ({f} * 1.15e0) <= iw"


def _fits_horizontal(f: str) -> str:
    """The texts of this query have no spaces, so a line takes as many glyphs as fit beside each other."""
    per = f"greatest(1, floor(iw / (0.95e0 * {f}) + 1e-9))"
    return f"(ceil(length(ko) / {per}) * {f} * 1.18e0 <= ih AND least(length(ko), {per}) * 0.95e0 * {f} <= iw + 1e-9)"


def _bisection(fits) -> str:
    sql = f"SELECT CAST(page_id AS VARCHAR) || '-' || CAST(id AS VARCHAR) AS block_id, ko, iw, ih, pad, CAST(2 AS BIGINT) AS lo, CAST(greatest(2, floor(least(256.0, greatest(greatest(2.0, iw), greatest(ih, floor(20 * least(800.0 / width, 1200.0 / height))))))) AS BIGINT) AS hi, CAST(2 AS BIGINT) AS best FROM ({_QA}) r3"
    for _ in range(8):
        sql = f"SELECT block_id, ko, iw, ih, pad, CASE WHEN lo <= hi AND ok THEN f + 1 ELSE lo END AS lo, CASE WHEN lo <= hi AND NOT ok THEN f - 1 ELSE hi END AS hi, CASE WHEN lo <= hi AND ok THEN f ELSE best END AS best FROM (SELECT *, {fits('f')} AS ok FROM (SELECT *, (lo + hi) // 2 AS f FROM ({sql}) a) b) c"
    return f"SELECT block_id, best AS font_px, NOT ({fits('best')}) AS overflow, pad AS padding FROM ({sql}) q"


@query("block_id string, font_px bigint, overflow boolean, padding bigint", _bisection(_fits_vertical))
def k12_layout_vertical(b):
    """Fit is not monotone in the font (columns are whole), so the SQL takes the same eight steps."""
    return layout.layout_qa(_qa_blocks(b, "vertical"), 800, 1200)


def _qa_blocks(b, direction: str):
    return _boxes(b).select(F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("id").cast("string")).alias("block_id"), F.col("ko").alias("text"), "bbox", F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("render_bbox"), "width", "height", F.lit(direction).alias("render_direction"), F.lit(20.0).alias("font_size_px"), F.lit(1.18).alias("line_height"), F.lit(True).alias("auto_fit_text"))


@query("block_id string, font_px bigint, overflow boolean, padding bigint", _bisection(_fits_horizontal))
def k12_layout_horizontal(b):
    return layout.layout_qa(_qa_blocks(b, "horizontal"), 800, 1200)


@query("part_id bigint, css string", "SELECT p_partkey AS part_id, 'rgba(' || CAST(p_partkey % 16 * 16 + p_partkey % 16 AS VARCHAR) || ', 17, 255, ' || CASE WHEN p_partkey % 2 = 0 THEN '0.5' ELSE '1' END || ')' AS css FROM part")
def k13_rgba(b):
    d = "substring('0123456789abcdef', CAST(p_partkey % 16 + 1 AS INT), 1)"
    rows = b(f"SELECT p_partkey AS part_id, concat('#', {d}, {d}, '11ff') AS c, CASE WHEN p_partkey % 2 = 0 THEN 0.5D ELSE 7.0D END AS a FROM part")
    return rows.select("part_id", g.rgba(F.col("c"), F.col("a")).alias("css"))


@query("chapter_id bigint, status string, n_blocks bigint, n_uncertain bigint, sum_font double", f"""SELECT c.chapter_id, CASE WHEN p.chapter_id IS NULL THEN 'idle' WHEN p.done THEN 'completed' WHEN p.busy THEN 'running' WHEN p.lost THEN 'failed' WHEN p.some_ THEN 'partial' ELSE 'idle' END AS status, coalesce(f.n, 0) AS n_blocks, coalesce(f.u, 0) AS n_uncertain, coalesce(f.s, 0) AS sum_font
FROM b_chapters c LEFT JOIN (SELECT chapter_id, bool_and(analysis_status = 'completed') AS done, bool_or(analysis_status = 'running') AS busy, bool_and(analysis_status = 'failed') AS lost, bool_or(analysis_status = 'completed') AS some_ FROM b_pages GROUP BY chapter_id) p ON p.chapter_id = c.chapter_id
LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE contains(jp, '[?]')) AS u, sum(font) AS s FROM ({_FONTED}) x GROUP BY 1) f ON f.page_id = c.chapter_id""")
def chapter_report(b):
    """Replies parsed, typed, measured and rolled up per chapter, with its derived status."""
    blocks = blk.items_to_blocks(_records(b), b.b_sizes)
    per = blocks.groupBy(F.col("page_id").alias("chapter_id")).agg(F.count("*").alias("n_blocks"), F.count_if(F.contains("source_text", F.lit("[?]"))).alias("n_uncertain"), F.sum("font_size_px").alias("sum_font"))
    return chapter_status(b.b_chapters, b.b_pages).join(per, "chapter_id", "left").na.fill(0)
