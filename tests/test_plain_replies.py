"""Plain records and objects are read by one match, as all rules would read them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import replies as rep

NEVER = r"(?!)"
TEXTS = ("J5", "K7", "네, 그래요", "J3[?]", "", " ", "a, b ,", "it's", 'say "hi"', "x: 5", "ko: no", "ko", "a\\nb", "tail\u00a0", "\u3000가", "x", "-", "{", "b }", "line\u2028sep", "12", "null", "h, y", "a'", ", c", "a, jp", "\x85z", "id", "}]", "KO: z, ko")
NUMBERS = ("1", "20", "3.5", "-4", "1e3", "", "x", "0x1F", "007", "5px", ".5", "1.", "null", "12345678901234567890")


def _object(rng: random.Random) -> str:
    q = lambda: rng.choice(('"', '"', '"', "'", ""))
    gap = lambda: rng.choice(("", "", " ", " ", "\n"))
    key = lambda k: f"{q()}{k}{q()}{gap()}:{gap()}"

    def said(k: str) -> str:
        a = q()
        return f"{key(k)}{a}{rng.choice(TEXTS[:4] if rng.random() < 0.7 else TEXTS)}{a if rng.random() < 0.9 else q()}{gap()}"

    number = lambda k: f"{key(k)}{rng.choice(NUMBERS[:4] if rng.random() < 0.9 else NUMBERS)}{gap()}"
    sides = ("," + gap()).join(number(k) for k in (rng.choice("xxxa"), "y", "w", "h"))
    box = f"{key(rng.choice(('bbox', 'bbox', 'box')))}{{{gap()}{sides}{rng.choice(('', '', ','))}{gap()}}}" if rng.random() < 0.7 else sides + rng.choice(("", "}", " }"))
    fields = [f"{key('id')}{q()}{rng.choice(('1', 'i2', 'a b'))}{q()}", said("type"), box, said("jp"), said("ko")]
    if rng.random() < 0.15:
        fields.append(said(rng.choice(("ko", "jp", "korean", "type", "KO"))))
    if rng.random() < 0.1:
        rng.shuffle(fields)
    if rng.random() < 0.1:
        del fields[rng.randrange(len(fields))]
    return "{" + gap() + ("," + gap()).join(fields) + rng.choice(("", "", ",", "\n")) + "}"


def _record(rng: random.Random) -> str:
    q = lambda: rng.choice(('"', "'")) if rng.random() < 0.03 else ""
    gap = lambda: rng.choice(("", " ", " ", "\t"))
    line = lambda k, values, few: f"{gap()}{q()}{k}{q()}{gap()}:{gap()}{q()}{rng.choice(values[:few] if rng.random() < 0.95 else values)}{q()}{rng.choice(('', '', '', '', '', '', ',', ' '))}"
    lines = [line("type", TEXTS, 2), *[line(k, NUMBERS, 3) for k in (rng.choice("xxxaX"), "y", "w", "h")], line("jp", TEXTS, 5), line("ko", TEXTS, 4)]
    if rng.random() < 0.3:
        lines.append(line(rng.choice(("ko", "jp", "x", "h", "note", "bbox", "typed")), TEXTS + NUMBERS, 9))
    if rng.random() < 0.3:
        rng.shuffle(lines)
    return "\n".join([rng.choice((f"id: {rng.randrange(9)}", '"id": 3', "{ id : a9,", "id: 4 x: 7", "")), *lines]).strip("\n")


@pytest.mark.parametrize("name,make,sep", [("object", _object, ",\n"), ("fixed", _record, "\n\n"), ("compat", _record, "\n")])
def test_plain_forms_are_read_as_all_rules_read_them(spark, monkeypatch, name, make, sep):
    rng = random.Random(11)
    rows = [(k, sep.join(make(rng) for _ in range(3))) for k in range(1500)]
    texts = spark.createDataFrame([(k, f'{{"items": [{t},]}}' if name == "object" else t) for k, t in rows], "k long, text string").repartition(4)
    read = (lambda: rep.broken_items(F.col("text"))) if name == "object" else (lambda: rep.line_items(F.col("text"), name))
    got = {r.k: r.i for r in texts.select("k", read().alias("i")).collect()}
    monkeypatch.setattr(rep, "_plain_object", lambda: NEVER)
    monkeypatch.setattr(rep, "_plain_record", lambda mode: NEVER)
    want = {r.k: r.i for r in texts.select("k", read().alias("i")).collect()}
    odd = [(dict(rows)[k], got[k], want[k]) for k in want if got[k] != want[k]]
    assert not odd, f"{len(odd)}: {odd[0]}"


@pytest.mark.parametrize("text", [
    """{"id: 1, "type": 'sfx', "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}, "jp": "J[?]", "ko": "K, k"},""",
    "{id: 1, type: sfx, bbox: {a: 1, y: 2, w: 3, h: 4,}, jp: J[?], ko: K, k},]}",
    """{"id": i1, "type": "sfx",\n"x": 1, "y": 2, "w: 3, "h: 4 },\n"jp": "J[?]",\n"ko: K, k"\n}""",
])
def test_plain_object_takes_one_match(spark, text):
    p = spark.range(1).select(rep._plain(F.lit(text), rep._plain_object()).alias("p")).first().p.p
    assert p.split("\n") == ["", "sfx", "1", "2", "3", "4", "J[?]", "K, k"]


def test_plain_record_takes_one_match(spark):
    text = 'id: 7\nko: old\n"type": "sfx",\nx: 1\ny: 2.5\nw: 3\nh: 4\njp: \nko: K, k'
    p = spark.range(1).select(rep._plain(F.lit(text), rep._plain_record("fixed")).alias("p")).first().p.p
    assert p.split("\n") == ["", "sfx", "1", "2.5", "3", "4", "", "K, k"]


def test_plain_pattern_bears_many_lines(spark):
    text = "id: 1\n" + "x: 1\n" * 20000 + "ko: K"
    assert spark.range(1).select(rep._plain(F.lit(text), rep._plain_record("fixed")).alias("p")).first().p.p == text
    assert re.compile(r"\n").split(text)[-1] == "ko: K"


def _near_usual(rng: random.Random) -> str:
    odd = lambda s, other: s if rng.random() < 0.985 else rng.choice(other)
    said = lambda few: rng.choice(TEXTS[:few] if rng.random() < 0.95 else (*TEXTS, "\tt", "c\t", "x\x00", "`", "```json", "😀", "﻿b", "-", ",c", "c ,"))
    number = lambda: rng.choice(("1", "20", "1250", "0") if rng.random() < 0.985 else (*NUMBERS, "+5", "-0", " 7", "7 ", "9007199254740993"))

    def record(k: int) -> str:
        lines = [f"id: {odd(str(k), ('i2', '007', '', ' 3', '-1', '+2'))}", f"type: {said(2)}", *[f"{odd(s, ('a', s.upper(), ' ' + s))}: {number()}" for s in "xywh"], f"jp: {said(5)}", f"ko: {said(4)}"]
        if rng.random() < 0.02:
            a, b = rng.sample(range(8), 2)
            lines[a], lines[b] = lines[b], lines[a]
        if rng.random() < 0.02:
            lines[rng.randrange(8)] = rng.choice(("", "note: 1", "ko:", "jp:", "type:", "type: ", "x", "id: 5"))
        return "\n".join(lines)

    text = odd("\n\n", ("\n", "\n\n\n", "\n \n", "\r\n\r\n", "\nx\n")).join(record(k) for k in range(1, rng.randrange(2, 6)))
    return odd("", ("\n", " ", "{")) + text + rng.choice(("", "", "", "", "\n", "\n\n", " ", "x", "\r\n"))


def test_usual_replies_are_read_as_all_rules_read_them(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, _near_usual(rng)) for k in range(4000)]
    texts = spark.createDataFrame([*rows, (4000, None), (4001, ""), (4002, "\n" * 8)], "page_id long, text string").repartition(4)
    read = lambda: {r.page_id: (r["items"], r.error) for r in rep.parsed(texts, "page_id").collect()}
    lines = texts.select("page_id", "text", F.split("text", "\n").alias("u")).withColumn("u", rep._usual_read(F.col("u")))
    taken = lines.select(rep._usual_items(F.col("text"), F.col("u")).alias("i")).where("i IS NOT NULL").count()
    assert 1000 < taken < 3900
    got = read()
    monkeypatch.setattr(rep, "_usual_read", lambda lines: F.lit(None).cast("array<struct<id:bigint,type:string,x:bigint,y:bigint,w:bigint,h:bigint,jp:string,ko:string>>"))
    want = read()
    odd = [(dict(rows).get(k), got[k], want[k]) for k in want if got[k] != want[k]]
    assert len(got) == 4003 and not odd, f"{len(odd)}: {odd[0]}"


def test_usual_reply_needs_no_pattern(spark):
    text = "id: 1\ntype: sfx\nx: 1\ny: 2\nw: 3\nh: 4\njp: \nko: K, k: l\n\nid: 2\ntype: 말\nx: 5\ny: 6\nw: 7\nh: 8\njp: J[?]\nko: \n"
    found = spark.createDataFrame([(text,)], "text string").withColumn("u", F.split("text", "\n")).withColumn("u", rep._usual_read(F.col("u")))
    items = found.select(rep._usual_items(F.col("text"), F.col("u")).alias("i")).first().i
    assert [tuple(i) for i in items] == [("sfx", 1.0, 2.0, 3.0, 4.0, "", "K, k: l")]
