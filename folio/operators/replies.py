"""Model replies to typed records, in Spark expressions only.

A reply is one row from text to records: strict JSON is read as VARIANT; what looks like JSON but is
broken is cut into objects, and each known field is found in its object by that field's own rule;
replies in lines are cut into records at blank lines and ids.  Every reply ends up as records or as
one error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.geometry import bbox
from folio.functions.text import BLANK, blank_to_null, js_number, js_trim

# Accepted keys, in order of preference.
KO_KEYS = ("ko", "korean", "translation", "translated", "text_ko")
JP_KEYS = ("jp", "japanese", "source", "ocr", "text_jp")
BOX_KEYS = ("bbox", "box", "rect", "region")
SIDE_KEYS = {"x": ("x", "left"), "y": ("y", "top"), "w": ("w", "width"), "h": ("h", "height")}
CORNERS = ("x1", "y1", "x2", "y2")
DEFAULT_TYPE = "dialogue"
ITEM = "struct<type:string,x:double,y:double,w:double,h:double,jp:string,ko:string>"
NO_PAYLOAD, NOT_JSON = "Failed to find a parseable structured payload in the model output.", "Failed to parse model output as JSON."
_START = r"(?m)^\s*\"?id\"?\s*:"
#: An object with a key that is no field's value: such a reply is JSON, however broken, and not lines.
_JSON_LIKE = r"\{(?<!:\s{0,4}\{)\s*[\"']?[A-Za-z_]+[\"']?\s*:"
_FENCE = r"(?i)```(?:json)?"
#: An object begins at a brace with a key behind it, unless the brace is a field's value.
_OBJECT = r"(?<=[\[,}])\s*(?=\{\s*[\"']?[A-Za-z_]+[\"']?\s*:?)"
_ANY_KEY = "|".join(("id", "type", *BOX_KEYS, *JP_KEYS, *KO_KEYS, *(k for pair in SIDE_KEYS.values() for k in pair)))
#: Where a broken text value ends: before the next field, the end of its object, or the end of its line.
_ENDS = rf"[\"']?\s*(?=,?\s*(?:\n|$)|,?\s*\}}\s*(?:[,\]}}]|$)|,\s*[\"']?(?:{_ANY_KEY})[\"']?\s*:)"
#: A text value: between quotes of its own, or, where those are torn, up to what ends it.
_VALUE = rf"(?:\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+')(?=\s*(?:[,}}\]\n]|$))|.*?{_ENDS}"

#: Characters within a plain text: none that quotes, ends or escapes one, none that makes a key; at its ends neither blanks nor commas.
_ODD = "\"'{}\\\\\\n\\r\\x0B\\f\\x85\\u2028\\u2029"


#: The same without the line break, and that of fences, for replies that no pattern reads; and what ends no plain text, as code points.
_ODD_CHARS = "\"'{}\\`\r\x0b\f\x85\u2028\u2029"
_EDGES = tuple(map(ord, "," + BLANK))
#: Fields of a record of lines in their usual order.
RECORD = ("id", "type", *SIDE_KEYS, "jp", "ko")


def _plain_text(odd: str) -> str:
    edge = f"[,{BLANK}]"
    return f"(?!{edge})[^{odd}]+(?<!{edge})"


def _plain_object() -> str:
    """An object in the usual order (id, type, box or sides, texts) whose texts hold no quote, brace, colon or backslash.

    One match gives its type, sides and texts as all rules of broken_items would: no key can be found inside such a text, and
    where a quote is missing or doubled in a key or at a text's end does not matter to them.
    """
    key = lambda k: rf"[\"']?{k}[\"']?\s*+:\s*+"
    text = rf"(?:{_plain_text(_ODD + ':')})?"
    quoted = "|".join(rf"{q}(?={text}{q}\s*[,}}\]\n])" for q in "\"'")
    said = lambda k: rf"{key(k)}(?:{quoted}|(?![\"']))({text}){_ENDS}"
    number = r"[\"']?(-?[0-9]{1,15}(?:\.[0-9]{1,15})?)(?=[\s,\"'}])[\"']?\s*+"
    sides = r",\s*+".join(key(k) + number for k in ("[xa]", "y", "w", "h"))
    head = rf"(?:{key('id')}[\"']?[A-Za-z0-9_-]*[\"']?\s*+,\s*+)?(?:{said('type')},\s*+)?"
    box = rf"(?:{key('bbox')}\{{\s*+)?{sides},?\s*+\}}?\s*+"
    return rf"\A\{{\s*+{head}{box}(?:,\s*+(?:{said('jp')}|{said('ko')})){{0,4}},?\s*+\}}[\s,\]}}]*+\z"


def _plain_record(mode: str) -> str:
    """A record of lines with plain keys, in any order, the last line of a field counting, and plain texts; numbers are whole ones or decimals."""
    key = lambda k: rf"\"?{k}\"?[ \t]*+:[ \t]*+"
    text = _plain_text(_ODD + ":" if mode == "compat" else _ODD)
    said = lambda k, empty: rf"{key(k)}(?:[\"']?({text})[\"']?,?{'|' if empty else ''})"
    side = lambda k: rf"[\"']?{k}[\"']?[ \t]*+:[ \t]*+([0-9]{{1,15}}(?:\.[0-9]{{1,15}})?),?"
    line = "|".join((said("type", False), *map(side, ("[xa]", "y", "w", "h")), said("jp", True), said("ko", True)))
    return rf"\A(?:{key('id')}[\"']?[A-Za-z0-9_-][^\n]*+)?+(?:(?:\A|\n)[ \t]*+(?:{line})[ \t]*+){{1,16}}\z"


def _usual_read(lines: Column) -> Column:
    """(RECORD, id and sides as whole numbers) of every record of a reply of which eight lines and a blank one are a record; lines must be a column."""
    after = lambda r, at, key: F.substring(F.get(lines, r + at), len(key) + 3, 1 << 30)
    record = lambda r: F.struct(*[(after(r, at, k) if k in ("type", "jp", "ko") else after(r, at, k).try_cast("bigint")).alias(k) for at, k in enumerate(RECORD)])
    upto = F.size(lines) - F.when(F.size(lines) % 9 == 0, 9).otherwise(8)
    return F.when((F.size(lines) > 0) & (F.size(lines) % 9).isin(0, 8), F.transform(F.sequence(F.lit(0), upto, F.lit(9)), record))


def _usual_items(text: Column, found: Column) -> Column:
    """Whole ITEMs of a usual reply, null for others: one that its records, as _usual_read found them, give back to the letter.

    Keys are in their usual order then, a line each; with plain texts and whole numbers all rules of mode "fixed" would read the
    same.  Nothing is matched, since patterns cost many times as much as these comparisons.
    """
    inside = lambda c: ~F.ascii(c).isin(*_EDGES) & ~F.ascii(F.substring(c, -1, 1)).isin(*_EDGES)
    shown = lambda p: F.concat(*[x for at, k in enumerate(RECORD) for x in (F.lit(f"{chr(10) if at else ''}{k}: "), p[k].cast("string"))])
    item = lambda p: F.struct(p["type"].alias("type"), *[p[k].cast("double").alias(k) for k in SIDE_KEYS], p["jp"].alias("jp"), F.nullif(p["ko"], F.lit("")).alias("ko"))
    usual = found.isNotNull()
    for odd in (*_ODD_CHARS, ": -", "type: \n"):
        usual = usual & ~F.contains(text, F.lit(odd))
    back = F.array_join(F.transform(found, shown), "\n\n")  # a record with anything missing is left out, and so the text is not whole
    usual = usual & text.startswith(back) & (F.octet_length(text) - F.octet_length(back) <= 1) & F.forall(found, lambda p: inside(p["type"]) & inside(p["jp"]) & inside(p["ko"]))
    return F.when(usual, F.filter(F.transform(found, item), whole_item))


def _plain(c: Column, pattern: str) -> Column:
    """The text and, where the pattern matches it, its seven groups, each after a line break."""
    return F.struct(c.alias("o"), F.regexp_replace(c, pattern, "".join(f"\n${k}" for k in range(1, 8))).alias("p"))


def _plain_or(p: Column, rest) -> Column:
    """ITEM of what _plain has found, else of the text by all rules; blank texts are missing, as are sides not found."""
    f = F.split(p["p"], "\n")

    def item(f: Column) -> Column:
        said = lambda k: F.nullif(f[k], F.lit(""))
        return F.struct(F.coalesce(said(1), F.lit(DEFAULT_TYPE)).alias("type"), *[f[k].try_cast("double").alias(side) for k, side in enumerate(SIDE_KEYS, 2)], f[6].alias("jp"), said(7).alias("ko"))

    return F.when(p["p"].startswith("\n") & ~p["o"].startswith("\n"), F.get(F.transform(F.array(f), item), 0)).otherwise(F.get(rest(F.array(p["o"])), 0))


def extract_payload(text: Column) -> Column:
    """The part of a reply that should be JSON; null if there is none."""
    return _payload(js_trim(text))


def _unfenced(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("```")), F.regexp_replace(c, _FENCE, "")).otherwise(c)


def _payload(t: Column) -> Column:
    fenced = F.when(F.contains(t, F.lit("```")), F.nullif(js_trim(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1)), F.lit("")))

    def between(a: str, b: str) -> Column:
        first, last = F.instr(t, a), F.length(t) - F.instr(F.reverse(t), b) + 1
        return F.when((first > 0) & (F.instr(t, b) > 0) & (last > first), F.substring(t, first, last - first + 1))

    return F.when(t.startswith("{") | t.startswith("["), t).otherwise(F.coalesce(fenced, between("{", "}"), between("[", "]")))


def strict_value(c: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, without repeated keys; else null.

    The parser stops at the end of a value and overlooks what follows, so the text is read inside
    brackets and inside an object, of which at least one then ends in the wrong place.
    """
    c = F.trim(c, F.lit("\ufeff"))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    whole = keyed.isNotNull() & F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
    return F.when(whole, F.try_variant_get(keyed, "$.v", "variant"))


def strict(c: Column) -> Column:
    return strict_value(c).isNotNull()


def without_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


def parse_json_strict(c: Column) -> Column:
    """VARIANT of the text as it is, or without trailing commas; null if neither is strict JSON."""
    return F.coalesce(strict_value(c), F.when(c.rlike(r",\s*[}\]]"), strict_value(without_trailing_commas(c))))


def _text(v: Column, path: str) -> Column:
    """A member that is a string, else null (numbers and objects do not count)."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _members(v: Column, keys: tuple[str, ...]) -> Column:
    """The members of an object by these keys, each as it is, found in one pass; null if they are missing or v is no object."""
    return F.try_variant_get(v, "$", f"struct<{','.join(f'{k}:variant' for k in keys)}>")


def _real(raw: Column) -> Column:
    """Neither missing nor JSON null."""
    return raw.isNotNull() & ~F.is_variant_null(raw)


def _opened(v: Column) -> Column:
    return F.struct(v.alias("v"), _members(v, ("type", *JP_KEYS, *KO_KEYS, *BOX_KEYS)).alias("m"))


def _boxed(p: Column) -> Column:
    """An item's texts, trimmed, null where a member is no string, and its box: the first that is there, or the item itself."""
    m = p["m"]
    texts = [F.when(F.schema_of_variant(m[k]) == "STRING", js_trim(F.try_variant_get(m[k], "$", "string"))).alias(k) for k in ("type", *JP_KEYS, *KO_KEYS)]
    box = F.coalesce(*[F.when(_real(m[k]), m[k]) for k in BOX_KEYS], p["v"])
    return F.struct(F.struct(*texts).alias("t"), _members(box, (*CORNERS, *(k for pair in SIDE_KEYS.values() for k in pair))).alias("b"))


def _sided(p: Column) -> Column:
    """Texts, whether the box has all corners, and its four values as they are: corners, or sides by either of their names."""
    b = p["b"]
    corners = b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull()
    own = {k: F.when(_real(b[a]), b[a]).otherwise(b[other]) for k, (a, other) in SIDE_KEYS.items()}
    return F.struct(p["t"].alias("t"), corners.alias("corners"), *[F.when(corners, b[c]).otherwise(own[k]).alias(k) for c, k in zip(CORNERS, SIDE_KEYS)])


def _kinds(p: Column) -> Column:
    return F.struct(p["t"].alias("t"), p["corners"].alias("corners"), *[F.struct(p[k].alias("raw"), F.schema_of_variant(p[k]).alias("kind")).alias(k) for k in SIDE_KEYS])


def _number(v: Column) -> Column:
    """Script-engine number of a member and its kind: null if it is missing or not a number."""
    raw, kind = v["raw"], v["kind"]
    as_ = lambda t: F.try_variant_get(raw, "$", t)
    return F.when(raw.isNull(), None).when(F.is_variant_null(raw), 0.0).when(kind == "BOOLEAN", as_("boolean").cast("double")).when(kind == "STRING", js_number(as_("string"))).otherwise(as_("double"))


def _numbers(p: Column) -> Column:
    return F.struct(p["t"].alias("t"), p["corners"].alias("corners"), *[_number(p[k]).alias(k) for k in SIDE_KEYS])


def variant_item(p: Column) -> Column:
    """ITEM struct of one parsed item, by the aliases; a missing box side is null."""
    t, size = p["t"], {k: F.when(p["corners"], p[k] - p[a]).otherwise(p[k]) for k, a in (("w", "x"), ("h", "y"))}
    first = lambda keys: F.coalesce(*[F.when(t[k] != "", t[k]) for k in keys])
    return F.struct(F.coalesce(first(("type",)), F.lit(DEFAULT_TYPE)).alias("type"), p["x"].alias("x"), p["y"].alias("y"), size["w"].alias("w"), size["h"].alias("h"), F.coalesce(first(JP_KEYS), F.lit("")).alias("jp"), first(KO_KEYS).alias("ko"))


def variant_items(v: Column) -> Column:
    """Array of VARIANT items of a parsed payload: itself, its items or its blocks; empty otherwise."""
    none = F.expr("cast(array() as array<variant>)")
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.items", "array<variant>"), F.try_variant_get(v, "$.blocks", "array<variant>"), none)


def json_items(v: Column) -> Column:
    """Whole ITEMs of a parsed payload, read in steps so that a step's fields are found once."""
    found = variant_items(v)
    for step in (_opened, _boxed, _sided, _kinds, _numbers, variant_item):
        found = F.transform(found, step)
    return F.filter(found, whole_item)


def whole_item(item: Column) -> Column:
    """Whether an ITEM has a translation and a whole box."""
    return item["ko"].isNotNull() & item["x"].isNotNull() & item["y"].isNotNull() & item["w"].isNotNull() & item["h"].isNotNull()


def _struct(kind: Column, sides: dict[str, Column], jp: Column, ko: Column) -> Column:
    return F.struct(F.coalesce(blank_to_null(kind), F.lit(DEFAULT_TYPE)).alias("type"), *[v.cast("double").alias(k) for k, v in sides.items()], F.coalesce(js_trim(jp), F.lit("")).alias("jp"), blank_to_null(ko).alias("ko"))


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def _first(*texts: Column) -> Column:
    """The first text that is not blank; those behind it are not looked for, and each is looked for once."""
    said = lambda c: F.get(F.filter(F.array(c), lambda x: x.isNotNull() & (js_trim(x) != "")), 0)
    return F.coalesce(*map(said, texts))


def _unescaped(c: Column) -> Column:
    quoted = F.try_parse_json(F.concat(F.lit('"'), c, F.lit('"')))
    return F.when(F.contains(c, F.lit("\\")), F.coalesce(F.try_variant_get(quoted, "$", "string"), c)).otherwise(c)


def broken_items(payload: Column) -> Column:
    """ITEMs, whole or not, of a JSON-like text that is no JSON: quotes, keys, braces or commas missing or odd.

    Every object is read in steps, so that a step's fields are found once: its box, then all fields as texts, then values.
    """
    boxed = rf"(?is)[\"']?(?:{'|'.join(BOX_KEYS)})[\"']?\s*:\s*\{{([^}}]*)"
    said = rf"(?i)[\"']?\b(?:{'|'.join((*JP_KEYS, *KO_KEYS))})[\"']?\s*:\s*(?:{_VALUE})"
    sides = {k: (k, "a", other) if k == "x" else (k, other) for k, (k, other) in SIDE_KEYS.items()}
    number = lambda box, k: F.nullif(F.regexp_extract(box, rf"(?:^|[{{,\s\"'])[\"']?{k}[\"']?\s*:\s*[\"']?([^\s,\"'}}]+)", 1), F.lit("null"))

    def parts(o: Column) -> Column:
        return F.struct(o.alias("o"), F.regexp_extract(o, boxed, 1).alias("box"))

    def placed(p: Column) -> Column:
        return F.struct(p["o"].alias("o"), F.when(p["box"] != "", p["box"]).otherwise(F.regexp_replace(p["o"], said, "")).alias("box"))

    def fields(p: Column) -> Column:
        text = lambda k: F.regexp_replace(js_trim(_last(F.regexp_extract_all(p["o"], F.lit(rf"(?i)(?:^|[{{,\n])\s*[\"']?{k}[\"']?\s*:\s*({_VALUE})"), F.lit(1)))), r"^[\"']|[\"']$", "")
        own = [_first(*[number(p["box"], k) for k in keys]).alias(k) for k, keys in sides.items()]
        return F.struct(text("type").alias("type"), _first(*map(text, JP_KEYS)).alias("jp"), _first(*map(text, KO_KEYS)).alias("ko"), *own, p["box"].alias("box"))

    def numbers(f: Column) -> Column:
        return F.struct(*[_unescaped(f[k]).alias(k) for k in ("type", "jp", "ko")], *[js_number(f[k]).alias(k) for k in sides], f["box"].alias("box"))

    def cornered(v: Column) -> Column:
        """Corners are looked for only where a side is missing."""
        lacks = v["x"].isNull() | v["y"].isNull() | v["w"].isNull() | v["h"].isNull()
        return F.struct(v.alias("v"), F.when(lacks, F.struct(*[js_number(_first(number(v["box"], k))).alias(k) for k in CORNERS])).alias("c"))

    def item(p: Column) -> Column:
        v, c = p["v"], p["c"]
        corner = {"x": c["x1"], "y": c["y1"], "w": c["x2"] - c["x1"], "h": c["y2"] - c["y1"]}
        return _struct(v["type"], {k: F.coalesce(v[k], x) for k, x in corner.items()}, v["jp"], v["ko"])

    def read(found: Column) -> Column:
        for step in (parts, placed, fields, numbers, cornered, item):
            found = F.transform(found, step)
        return found

    found, pattern = F.split(js_trim(_unfenced(payload)), _OBJECT), _plain_object()
    found = F.transform(F.slice(found, 2, 1 << 30), lambda o: _plain(o, pattern))  # before the first object stands what holds them all
    found = F.transform(found, lambda p: _plain_or(p, read))
    return F.filter(found, lambda i: i["ko"].isNotNull() | i["x"].isNotNull() | i["y"].isNotNull() | i["w"].isNotNull() | i["h"].isNotNull())


def line_items(text: Column, mode: str = "fixed") -> Column:
    """Whole ITEMs of a reply in lines; a blank line or an id begins a record, the last line of a field counts.

    A line of coordinates may hold several.  In mode "fixed" it must begin with one; in mode
    "compat" any line that holds one is no text.
    """
    id_line = r"(?i)^\{?\s*\"?id[^:\"]*\"?\s*:\s*[\"']?[A-Za-z0-9_-]+"
    rule = lambda key: rf"(?i)^\"?{key}[^:\"]*\"?\s*:\s*[\"']?(.+?)[\"']?,?$"
    coordinates = r"[\"']?[xywha][\"']?\s*:\s*[0-9.]" if mode == "compat" else r"(?i)^[{\s\"']*(?:\"?bbox\"?\s*:\s*\{?\s*)?[\"']?[xywha][\"']?\s*:"
    text = js_trim(F.replace(_unfenced(text), F.lit("\r\n"), F.lit("\n")))

    typed, placed = lambda x: x.rlike(rule("type")), lambda x: x.rlike(coordinates)

    def lines(record: Column) -> Column:
        return F.filter(F.transform(F.split(record, "\n"), js_trim), lambda x: (x != "") & ~x.rlike(id_line))

    def sorted_(found: Column) -> Column:
        kinds = F.transform(found, lambda x: F.struct(x.alias("x"), F.when(typed(x), "t").when(placed(x), "b").otherwise("s").alias("k")))
        return F.struct(kinds.alias("a"))

    def fields(p: Column) -> Column:
        of = lambda kind: F.transform(F.filter(p["a"], lambda y: y["k"] == kind), lambda y: y["x"])
        last = lambda key, kind: _last(F.filter(of(kind), lambda x: x.rlike(rule(key))))
        return F.struct(F.array_join(of("b"), "\n").alias("box"), *[last(key, kind).alias(key) for key, kind in (("type", "t"), ("jp", "s"), ("ko", "s"))])

    def item(f: Column) -> Column:
        side = lambda k: _last(F.regexp_extract_all(f["box"], F.lit(rf"[\"']?{k}[\"']?\s*:\s*([0-9.]+)"), F.lit(1))).try_cast("double")
        return _struct(F.regexp_extract(f["type"], rule("type"), 1), {k: side("[xa]" if k == "x" else k) for k in SIDE_KEYS}, *[F.regexp_extract(f[k], rule(k), 1) for k in ("jp", "ko")])

    records = F.split(text, r"(?i)\n(?:\s*\n|(?=[ \t]*\{?[ \t]*\"?id[^:\"\n]*\"?[ \t]*:[ \t]*[\"']?[A-Za-z0-9_-]))")

    def read(found: Column) -> Column:
        for step in (lines, sorted_, fields, item):
            found = F.transform(found, step)
        return found

    pattern = _plain_record(mode)
    records = F.transform(F.transform(records, lambda o: _plain(o, pattern)), lambda p: _plain_or(p, read))
    return F.filter(records, whole_item)


def normalize_items(items: DataFrame, key: str = "reply_id") -> DataFrame:
    """(key, pos, type, x, y, w, h, jp, ko) -> (key, id, type, bbox, jp, ko): items lacking text or box go, the rest number from 1."""
    whole = items.where("ko IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL")
    n = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return whole.select(key, n.alias("id"), "type", bbox(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("bbox"), "jp", "ko")


def parsed(replies: DataFrame, key: str = "reply_id", mode: str = "fixed") -> DataFrame:
    """(key, text) -> (key, items: whole ITEMs or null, error): one row per reply, each text read once."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c) if isinstance(c, str) else c)
    rows = replies.select(key, "text", (F.split("text", "\n") if mode == "fixed" else F.lit(None).cast("array<string>")).alias("usual"))
    rows = rows.withColumn("usual", _usual_read(F.col("usual")))
    rows = rows.withColumn("usual", _usual_items(F.col("text"), F.col("usual")))
    rows = rows.withColumn("usual", some("usual"))
    rows = rows.select(key, "usual", F.when(F.col("usual").isNull(), js_trim(F.coalesce("text", F.lit("")))).alias("t"))  # null where nothing is left to read
    rows = rows.withColumn("payload", _payload(F.col("t")))
    in_lines = F.col("t").rlike(_START) & ~F.col("t").startswith("{") & ~F.col("t").startswith("[") & ~F.col("t").rlike(_JSON_LIKE) if mode == "fixed" else F.lit(False)
    rows = rows.withColumn("lines", F.when(in_lines | F.col("payload").isNull(), line_items(F.col("t"), mode)))
    rows = rows.withColumn("lines", some("lines"))
    rows = rows.withColumn("v", F.when(F.col("lines").isNull(), parse_json_strict(F.col("payload"))))
    rows = rows.withColumn("items", F.coalesce("lines", F.when(F.col("v").isNotNull(), json_items(F.col("v")))))
    rows = rows.withColumn("mended", F.when(F.col("items").isNull() & F.col("payload").isNotNull(), broken_items(F.col("payload"))))
    rows = rows.withColumn("late", F.when(F.size("mended") == 0, line_items(F.col("payload"), mode)))
    items = F.coalesce("usual", "items", F.when(F.size("mended") > 0, F.filter("mended", whole_item)), some("late"))
    rows = rows.select(key, "payload", items.alias("items"))
    return rows.select(key, "items", F.when(F.col("items").isNull(), F.when(F.col("payload").isNull(), NO_PAYLOAD).otherwise(NOT_JSON)).alias("error"))


def parse_replies(replies: DataFrame, key: str = "reply_id", mode: str = "fixed") -> tuple[DataFrame, DataFrame]:
    """(key, text) -> (records: key, id, type, bbox, jp, ko; errors: key, error).

    mode "compat" reads line replies as a marker-hijacked slice would be; "fixed" reads them whole.
    A null text is an empty reply and an error.  Records are numbered from 1 inside their reply, so nothing is shuffled.
    """
    read = parsed(replies, key, mode)
    rows = read.select(key, F.posexplode(F.coalesce("items", F.expr(f"cast(array() as array<{ITEM}>)"))).alias("pos", "i"))
    i = F.col("i")
    records = rows.select(key, (F.col("pos") + 1).alias("id"), i["type"].alias("type"), bbox(i["x"], i["y"], i["w"], i["h"]).alias("bbox"), i["jp"].alias("jp"), i["ko"].alias("ko"))
    # An error is exploded, not filtered for: a filter would be pushed below the reading and repeat it.
    return records, read.select(key, F.explode(F.array_compact(F.array("error"))).alias("error"))


def response_text(raw: Column) -> Column:
    """Answer text of a response body: its text, its first choice's message, or its outputs' parts."""
    v = F.try_parse_json(raw)
    join = lambda parts: F.nullif(js_trim(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")), F.lit(""))
    parts = F.transform(F.try_variant_get(v, "$.choices[0].message.content", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    outputs = F.flatten(F.transform(F.coalesce(F.try_variant_get(v, "$.output", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda o: F.transform(F.coalesce(F.try_variant_get(o, "$.content", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda p: F.coalesce(js_trim(_text(p, "$.text")), F.lit("")))))
    return F.coalesce(blank_to_null(_text(v, "$.output_text")), blank_to_null(_text(v, "$.choices[0].message.content")), join(parts), join(outputs), F.lit(""))


def nested_output(v: Column) -> Column:
    """Answer text of an event that is no delta: its text, its first choice's message, or its outputs' parts; trimmed as a whole."""
    none = F.expr("cast(array() as array<variant>)")
    listed = lambda x, path: F.coalesce(F.try_variant_get(x, path, "array<variant>"), none)
    chat = F.try_variant_get(v, "$.choices[0].message.content", "array<variant>")
    parts = F.transform(chat, lambda p: F.coalesce(_text(p, "$.text"), F.lit("")))
    texts = lambda o: F.filter(F.transform(listed(o, "$.content"), lambda p: _text(p, "$.text")), lambda x: x.isNotNull())
    outputs = F.flatten(F.transform(listed(v, "$.output"), lambda o: F.when(_text(o, "$.content").isNotNull(), F.array(_text(o, "$.content"))).otherwise(texts(o))))
    return js_trim(F.coalesce(_text(v, "$.output_text"), _text(v, "$.choices[0].message.content"), F.array_join(parts, "\n"), F.array_join(outputs, "\n"), F.lit("")))


ENDS = ("response.completed", "response.incomplete")


def parse_sse(bodies: DataFrame, key: str = "response_id", text: str = "body") -> DataFrame:
    """(key, body) -> (key, pos from 0 without gaps, type, delta, response, nested): events of an event stream that are JSON, in order."""
    blocks = F.split(F.regexp_replace(text, r"\r\n", "\n"), r"\n\n")
    data = lambda b: js_trim(F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: js_trim(F.substring(x, F.lit(6), F.length(x)))), "\n"))
    kept = lambda d: (d != "") & (d != "[DONE]") & strict(d) & F.try_parse_json(d).isNotNull()
    rows = bodies.select(key, F.posexplode(F.filter(F.transform(blocks, data), kept)).alias("pos", "data")).withColumn("v", F.try_parse_json("data"))
    v = F.col("v")
    rows = rows.select(key, "pos", _text(v, "$.type").alias("type"), _text(v, "$.delta").alias("delta"), F.to_json(F.try_variant_get("v", "$.response", "variant")).alias("response"), nested_output(v).alias("nested"))
    said = F.coalesce((F.col("type") == "response.output_text.delta") & F.col("delta").isNotNull(), F.lit(False)) | F.coalesce(F.col("type").isin(*ENDS) & ~F.col("response").isin("null", "false", "0", '""'), F.lit(False))
    return rows.withColumn("nested", F.when(~said, F.nullif(F.col("nested"), F.lit(""))))


def event_text(events: DataFrame) -> Column:
    """The part of the answer that an event of parse_sse carries."""
    nested = F.col("nested") if "nested" in events.columns else F.lit(None).cast("string")
    return F.coalesce(F.when(F.col("type") == "response.output_text.delta", F.col("delta")), nested)


def assemble_response(events: DataFrame, key: str = "response_id") -> DataFrame:
    """(key, pos, type, delta, response, nested) -> (key, text, n_events, response, error), parts joined in order of pos; an event that is there twice counts once."""
    heard = F.array_sort(F.collect_set(F.struct("pos", event_text(events).alias("d"))))
    ended = F.col("type").isin(*ENDS)
    out = events.groupBy(key).agg(heard.alias("heard"), F.max_by(F.when(ended, F.col("response")), F.when(ended, F.col("pos"))).alias("response"))
    out = out.withColumn("joined", F.array_join(F.transform("heard", lambda x: x["d"]), ""))
    said = F.coalesce(blank_to_null(F.col("joined")), F.nullif(response_text(F.col("response")), F.lit("")))
    return out.select(key, F.coalesce(said, F.lit("")).alias("text"), F.size("heard").cast("long").alias("n_events"), "response", F.when(said.isNull(), F.lit("Model returned an empty response.")).alias("error"))


def render_line_replies(items: DataFrame, key: str = "page_id", order: str = "item_ord") -> DataFrame:
    """(key, order, type, x, y, w, h, jp, ko) -> (key, text): line replies, records in order."""
    shown = lambda c: F.col(c).cast("string")
    rec = F.concat(F.lit("id: "), shown(order), *[p for k in ("type", "x", "y", "w", "h", "jp", "ko") for p in (F.lit(f"\n{k}: "), shown(k))])
    return items.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), rec.alias("r")))), lambda x: x["r"]), "\n\n").alias("text"))
