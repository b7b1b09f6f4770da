"""Enumerations, their display texts, failure classes and settings rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import blank_to_null, js_number, js_trim

# Words of the data model and texts shown for them.
BLOCK_TYPES = {"speech": ("speech", "dialogue", "dialog", "balloon", "bubble"), "sfx": ("sfx", "sound", "effect", "onomatopoeia"), "caption": ("caption", "narration", "name")}
PAGE_STATUSES = ("idle", "running", "completed", "failed")
PHASE_TEXT = {"booting": "모델 준비 중", "model_downloading": "모델 다운로드/서버 준비 중", "ready": "모델 준비 완료", "finalizing": "결과 정리 중", "done": "번역 완료", "cancelled": "작업이 취소됨", "failed": "작업 실패"}
PAGE_PHASE_TEXT = {"page_running": "번역 중", "page_done": "완료", "page_skipped": "건너뜀"}
STATUS_TEXT = {"starting": "모델 준비 중", "running": "작업 진행 중", "cancelling": "작업 취소 중", "cancelled": "작업이 취소됨", "failed": "작업 실패", "completed": "번역 완료"}
IDLE_TEXT = "대기 중"
SKIPPED_MARK, UNCERTAIN_MARK = "건너뜁니다", "불확실한 OCR"
WARNING_BOTH, WARNING_SKIPPED = "일부 페이지를 건너뛰었고 OCR 확인이 필요한 블록도 있습니다.", "일부 페이지는 건너뛰고 다음 페이지로 진행했습니다."
WARNING_UNCERTAIN, WARNING_OTHER = "일부 블록은 OCR 확인이 더 필요합니다.", "중간 경고가 있었지만 작업은 계속 진행되었습니다."
FAILURES = (
    ("image-preprocessing", ("build-page-variant",)),
    ("server-startup", ("llama-server", "timed out while waiting")),
    ("model-request", ("gemma request failed", "openai codex request failed", "request transport failed", "openai-oauth")),
    ("response-json-parse", ("json parse failed",)),
    ("overlay-parse", ("구조화 형식으로 해석하지 못했습니다", "parseable structured payload")),
    ("empty-model-response", ("empty response",)),
    ("empty-overlay-items", ("bbox 결과를 만들지 못했습니다",)),
)
EFFORTS = ("none", "low", "medium", "high", "xhigh")


def cases(c: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def _word(c: Column) -> Column:
    return F.lower(js_trim(F.coalesce(c.cast("string"), F.lit(""))))


def block_type(c: Column) -> Column:
    """Kind of a word; one that is written as in the table is found as it is, others trimmed and in lower case."""
    found = lambda w: [F.when(w.isin(*names), F.lit(kind)) for kind, names in BLOCK_TYPES.items()]
    return F.coalesce(*found(c.cast("string")), *found(_word(c)), F.lit("other"))


def one_of(c: Column, allowed: tuple[str, ...], fallback: Column | str) -> Column:
    """The trimmed lower-case word if it is allowed, else the fallback."""
    return F.when(_word(c).isin(*allowed), _word(c)).otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)


def source_direction(c: Column, fallback: Column | str = "vertical") -> Column:
    return one_of(c, ("horizontal", "vertical"), fallback)


def render_direction(c: Column, fallback: Column | str = "horizontal") -> Column:
    return one_of(c, ("horizontal", "vertical", "rotated", "hidden"), fallback)


def text_align(c: Column) -> Column:
    return one_of(c, ("left", "right"), "center")


def color(c: Column, fallback: str) -> Column:
    t = js_trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike("(?i)^#[0-9a-f]{6}$"), t).otherwise(F.lit(fallback))


def display_text(translated: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(translated, F.lit("")), F.nullif(source, F.lit("")), F.lit("..."))


def uncertain(jp: Column, ko: Column) -> Column:
    return F.coalesce(F.contains(jp, F.lit("[?]")), F.lit(False)) | F.coalesce(F.contains(ko, F.lit("[?]")), F.lit(False))


def classify_failure(message: Column) -> Column:
    """First class, in order, one of whose phrases the message holds."""
    m, out = F.lower(message), F.lit("unknown")
    for kind, phrases in reversed(FAILURES):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(m, F.lit(p))
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def page_label(index: Column, total: Column, suffix: str) -> Column:
    known = index.isNotNull() & total.isNotNull() & (total > 0)
    return F.when(known, F.concat(index.cast("string"), F.lit(" / "), total.cast("string"), F.lit(f" 페이지 {suffix}"))).otherwise(F.lit(f"페이지 {suffix}"))


def retry_label(index: Column, total: Column, attempt: Column, attempts: Column) -> Column:
    parts = [c.cast("string") for c in (index, total, attempt, attempts)]
    return F.coalesce(F.concat(parts[0], F.lit(" / "), parts[1], F.lit(" 페이지 재시도 "), parts[2], F.lit(" / "), parts[3]), F.lit("페이지 재시도 중"))


def job_label(phase: Column, status: Column, index: Column, total: Column, attempt: Column, attempts: Column) -> Column:
    out = cases(phase, PHASE_TEXT, cases(status, STATUS_TEXT, F.lit(IDLE_TEXT)))
    for k, v in PAGE_PHASE_TEXT.items():
        out = F.when(phase == k, page_label(index, total, v)).otherwise(out)
    return F.when(phase == "page_retry", retry_label(index, total, attempt, attempts)).otherwise(out)


def page_status_label(status: Column) -> Column:
    return cases(status, {"running": "진행", "completed": "완료", "failed": "실패"}, F.lit("대기"))


def chapter_status_label(status: Column) -> Column:
    return cases(status, {"running": "진행 중", "completed": "완료", "partial": "부분 완료", "failed": "실패"}, F.lit("대기"))


def warning_summary(any_row: Column, skipped: Column, uncertain_: Column) -> Column:
    """Sentence for a run's warnings; null when there are none."""
    said = F.when(skipped & uncertain_, WARNING_BOTH).when(skipped, WARNING_SKIPPED).when(uncertain_, WARNING_UNCERTAIN).otherwise(WARNING_OTHER)
    return F.when(any_row, said)


def setting_text(raw: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(raw), F.lit(default))


def setting_int(raw: Column, default: int, lo: int, hi: int) -> Column:
    """Whole number of the string, clamped; the default for anything else."""
    n = js_number(raw)
    return F.when(n == F.floor(n), F.least(F.lit(hi), F.greatest(F.lit(lo), F.least(n, F.lit(2e9)).cast("int")))).otherwise(F.lit(default))


def setting_bool(raw: Column, default: bool) -> Column:
    w = _word(raw)
    return F.when(w.isin("true", "1", "yes", "on"), True).when(w.isin("false", "0", "no", "off"), False).otherwise(F.lit(default))


def setting_effort(raw: Column, default: str) -> Column:
    return F.when(raw == "minimal", F.lit("low")).when(raw.isin(*EFFORTS), raw).otherwise(F.lit(default))
