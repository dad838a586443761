"""Text functions as Column expressions: tokens, dates, intents, secrets, signatures, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.columns import stripped
from mnemolake.functions.columns import text_of as _text

# Patterns, word lists and maps that results depend on.
WORD = r"(?U)([\w./:-]{2,})"
SIGNATURE_TOKEN = r"(?U)([\w一-龥./:-]{2,})"
NEGATIVE = r"(?i)不存在|虚构|假想|没有(?:这|该)|fictional|nonexistent|imaginary|made[- ]up|never indexed|no such|\bZ{3,}[A-Z0-9_-]*\b"
TEMPORAL = r"(?i)最新|最近|目前|本周|上周|今天|昨天|latest|recent|current|this week|20\d{2}[-/]\d{1,2}"
CROSS_SOURCE = r"(?i)关联|相关|对比|分别|cross|related|compare"
EXACT = r"(?i)\b\d{4}\.\d{4,5}(?:v\d+)?\b|[./][\w.-]+\.(?:md|yaml|yml)"
LATEST = r"(?i)\b(latest|recent|newest|current|most\s+recent|last)\b|最近|最新|当前|上次|最近一次"
SECRET_TEXT = r"(?i)-----BEGIN .*PRIVATE KEY-----|(?:api[_-]?key|access[_-]?token|password|secret)\s*[:=]\s*['\"]?[A-Za-z0-9_\-/.+=]{16,}|\bsk-[A-Za-z0-9_-]{16,}"
SECRET_PATH = r"(?i)(^|/)(\.env(?:\.|$)|.*\.(?:pem|key|p12|pfx|secret|secrets?))$"
REDACTIONS = (
    r"(?is)-----BEGIN [^-]+ PRIVATE KEY-----.*?-----END [^-]+ PRIVATE KEY-----",
    r"(?i)\b(?:sk|rk)-[A-Za-z0-9_-]{16,}\b",
    r"(?i)\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret)\s*[:=]\s*[^\s,;]+",
    r"(?i)\bBearer\s+[A-Za-z0-9._-]{16,}\b",
)
REDACTED = "[REDACTED_SECRET]"
REPLY_MARK = r"(?i)\[\[reply_to[^\]]*\]\]\s*"
CONTEXT_TAGS = "relevant-memories|user-persona|relevant-scenes|scene-navigation|memory-tools-guide|current_task_context|history_task_context"
INJECTED = rf"(?i)<(?:{CONTEXT_TAGS})[^>]*>[\s\S]*?</(?:{CONTEXT_TAGS})>"
DATE_TOKEN = r"(?i)(20\d{2}[-/]\d{1,2}(?:[-/]\d{1,2})?|20\d{2}-W\d{1,2})"
HAN_DATE = r"^(?:(\d{4})年)?(\d{1,2})月(?:(\d{1,2})(?:日|号)?)?$"
HAN = "[㐀-鿿]"
MARKDOWN_LINK = r"\[[^\]]+\]\(([^)]+)\)"
INLINE_PATH = r"(?i)(?<![A-Za-z0-9_./-])(?:[^\s`'\"()<>]+/)?[^\s`'\"()<>]+\.(?:md|mdx|txt|rst|yaml|yml|json)(?:#[^\s`'\"()<>]+)?"
DATED_LINE = "^(#|date:|Date:|observed_at:|review_date:)"
FAILURE_TAG = r"(?i)错误|失败|报错|异常|阻塞|timeout|error|failed|blocked"
REVISION_TAG = r"(?i)不对|错了|重做|改一下|重新|wrong|incorrect|redo"
NEW_TASK_TAG = r"(?i)换个|另一个|新任务|new task|new topic|moving on"
MEMORY_TYPES = (
    ("decision", r"(?i)决定|选择|采用|策略|decision|policy"),
    ("failure", r"(?i)失败|报错|异常|阻塞|原因|failure|error|blocked|root cause"),
    ("solution", r"(?i)修复|解决|方案|workaround|fix|solution|resolved"),
    ("handoff", r"(?i)交接|下一步|待办|handoff|next step|follow[- ]?up"),
)
DURABLE = r"(?i)决定|完成|修复|实现|计划|偏好|记住|配置|提交|合并|阻塞|结论|以后|迁移|上线|规则|decision|done|fixed|implemented|plan|prefer|remember|config|commit|merge|blocked|conclusion|policy"
TEAM_STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "what", "when", "where", "which", "about", "project", "memory", "team")
MEMORY_STOP_WORDS = ("what", "when", "where", "which", "with", "from", "this", "that", "about", "memory", "conversation", "evidence", "source", "latest", "recent", "and", "or")
GENERIC_SUPPORT = ("note", "report", "weekly", "paper", "model", "card", "update", "result", "项目", "公司", "我们", "你们", "他们", "咱们", "关于", "以及", "还有", "这个", "那个", "一下", "现在")
FEEDBACK_DELTA = {"helpful": 0.15, "up": 0.15, "correct": 0.15, "wrong": -0.35, "stale": -0.2, "not_helpful": -0.1, "down": -0.1}


def words(x: Column | str) -> Column:
    """Tokens of two or more word, dot, slash, colon or hyphen characters, folded, in order."""
    return F.regexp_extract_all(F.lower(_text(x)), F.lit(WORD), F.lit(1))


def plane_terms(x: Column | str, stop: tuple[str, ...]) -> Column:
    """Distinct tokens in order of first occurrence, without stop words."""
    return F.array_except(F.array_distinct(words(x)), F.array(*map(F.lit, stop)))


def intent(x: Column | str) -> Column:
    """First of negative, temporal, cross-source and exact that matches, else semantic."""
    q = _text(x)
    return F.when(q.rlike(NEGATIVE), "negative").when(q.rlike(TEMPORAL), "temporal").when(q.rlike(CROSS_SOURCE), "cross-source").when(q.rlike(EXACT), "exact").otherwise("semantic")


def is_latest(x: Column | str) -> Column:
    return _text(x).rlike(LATEST)


def has_secret(x: Column | str) -> Column:
    return _text(x).rlike(SECRET_TEXT)


def is_secret_path(path: Column | str) -> Column:
    p = F.replace(_text(path), F.lit("\\"), F.lit("/"))
    return p.rlike(SECRET_PATH) | F.exists(F.split(p, "/"), lambda part: part.startswith("."))


def redact(x: Column | str, most: int | None = None) -> Column:
    """Injected context and reply marks out, secrets replaced, NUL to space, trimmed, cut to `most` characters."""
    out = F.regexp_replace(F.regexp_replace(_text(x), INJECTED, ""), REPLY_MARK, "")
    for pattern in REDACTIONS:
        out = F.regexp_replace(out, pattern, F.lit(REDACTED))
    out = stripped(F.translate(out, "\0", " "))
    return out if most is None else F.substring(out, 1, most)


def term_count(hay: Column, term: Column) -> Column:
    """Non-overlapping occurrences of term in hay; 0 for an empty term."""
    n = F.length(term)
    return F.when(n > 0, (F.length(hay) - F.length(F.replace(hay, term, F.lit("")))) / n).otherwise(0).cast("int")


def term_forms(x: Column | str) -> Column:
    """Light inflection: ies to y, plural s, ing (and a doubled n), ed; distinct, two characters or more."""
    t = F.lower(_text(x))
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    ing = (n > 5) & t.endswith("ing")
    forms = F.array_compact(
        F.array(
            t,
            F.when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y"))),
            F.when((n > 4) & t.endswith("s") & ~t.endswith("ss"), cut(1)),
            F.when(ing, cut(3)),
            F.when(ing & cut(3).endswith("n"), cut(4)),
            F.when((n > 4) & t.endswith("ed"), cut(2)),
        )
    )
    return F.filter(F.array_distinct(forms), lambda f: F.length(f) >= 2)


def compound_parts(x: Column | str) -> Column:
    """Parts of a term cut at hyphens and slashes: two characters or more, not only digits."""
    return F.filter(F.split(_text(x), "[-/]"), lambda p: (F.length(p) >= 2) & ~p.rlike(r"^\p{Nd}+$"))


def han_iso_date(x: Column | str) -> Column:
    """A whole token written as a Han date, as an ISO fragment; null for any other or a bare month."""
    t = _text(x)
    year, month, day = (F.regexp_extract(t, HAN_DATE, k) for k in (1, 2, 3))
    pad = lambda c: F.lpad(c, 2, "0")
    good_month = month.try_cast("int").between(1, 12)
    stem = F.concat(pad(month), F.lit("-"), pad(day))
    full = F.when(day != "", F.when(day.try_cast("int").between(1, 31), F.when(year != "", F.concat(year, F.lit("-"), stem)).otherwise(stem))).when(year != "", F.concat(year, F.lit("-"), pad(month)))
    return F.when(t.rlike(HAN_DATE) & good_month, full)


def date_tokens(x: Column | str) -> Column:
    """Distinct ISO date fragments in order."""
    return F.array_distinct(F.regexp_extract_all(_text(x), F.lit(DATE_TOKEN), F.lit(1)))


def date_score(token: Column) -> Column:
    """Year, month and day of a date fragment as y * 1e6 + m * 1e4 + d * 100; missing parts are 0, a week stands as a month."""
    parts = F.transform(F.split(F.regexp_replace(token, "(?i)w", ""), "[-/]"), lambda p: p.try_cast("int"))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(0))
    return at(1) * 1_000_000 + at(2) * 10_000 + at(3) * 100


def link_targets(x: Column | str) -> Column:
    """Targets of Markdown links, then paths that stand in the text: without fragment and query, %-escapes undone; web and mail links left out."""
    raw = F.concat(F.regexp_extract_all(_text(x), F.lit(MARKDOWN_LINK), F.lit(1)), F.regexp_extract_all(_text(x), F.lit(INLINE_PATH), F.lit(0)))
    plain = lambda u: F.regexp_replace(F.regexp_replace(u, "(?s)#.*", ""), r"(?s)\?.*", "")
    unquoted = lambda u: stripped(F.coalesce(F.try_url_decode(F.replace(plain(u), F.lit("+"), F.lit("%2B"))), plain(u)))
    return F.array_distinct(F.filter(F.transform(raw, unquoted), lambda u: (u != "") & ~u.rlike("^(https?://|mailto:|#)")))


def posix_path(x: Column) -> Column:
    """Without empty and single-dot parts; a leading slash stays."""
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    return F.concat(F.when(x.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def document_dates(path: Column, text: Column) -> Column:
    """Distinct date fragments of the path, then of headings and dated fields, in order."""
    own = F.filter(F.transform(F.split(_text(text), r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]", -1), stripped), lambda line: line.rlike(DATED_LINE))
    return date_tokens(F.array_join(F.concat(F.array(path), own), "\n"))


def epoch_of(x: Column) -> Column:
    """Seconds of a time as ISO text (without a zone: UTC) or as a number (milliseconds from 1e11 on); null for any other text."""
    t = stripped(x.cast("string"))
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    zoned = F.try_to_timestamp(F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t), F.lit("Z"))))
    number = t.try_cast("double")
    return F.when(t == "", None).when(iso, F.unix_micros(zoned) / 1e6).otherwise(epoch_seconds(number))


def iso_of(x: Column, fallback: Column) -> Column:
    """A time as ISO text in UTC; `fallback` (a timestamp) where there is none to read."""
    at = F.coalesce(F.timestamp_micros(F.round(epoch_of(x) * 1e6).cast("bigint")), fallback)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") == "000000", "").otherwise(F.date_format(at, ".SSSSSS")), F.lit("Z"))


def is_question_turn(role: Column | str, content: Column | str) -> Column:
    """A user turn that ends with a question mark."""
    return (F.lower(F.trim(_text(role))) == "user") & F.rtrim(F.regexp_replace(_text(content), r"\s+$", "")).rlike("[?？]$")


def echo_form(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(_text(x), r"[^\p{L}\p{N}]", ""))


def is_echo(role: Column, excerpt: Column, query: Column) -> Column:
    """A question turn, or an excerpt that says nothing beyond the query."""
    e, q = echo_form(excerpt), echo_form(query)
    same = (e == q) | F.contains(q, e) | (F.contains(e, q) & (F.length(e) < F.length(q) * 1.15))
    return is_question_turn(role, excerpt) | ((e != "") & (q != "") & same)


def signature(x: Column | str) -> Column:
    """Tags and the first eight distinct tokens, sorted, as a bucket name of 220 characters at most."""
    t = _text(x)
    tags = F.array_compact(F.array(F.when(t.rlike(FAILURE_TAG), "failure"), F.when(t.rlike(REVISION_TAG), "revision"), F.when(t.rlike(NEW_TASK_TAG), "new-task")))
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(SIGNATURE_TOKEN), F.lit(1)), F.lower))
    joined = F.substring(F.array_join(F.concat(tags, F.array_sort(F.slice(tokens, 1, 8))), "|"), 1, 220)
    return F.when(joined == "", "empty").otherwise(joined)


def memory_type(x: Column | str) -> Column:
    out = None
    for name, pattern in MEMORY_TYPES:
        out = (F.when if out is None else out.when)(_text(x).rlike(pattern), name)
    return out.otherwise("discovery")


def is_durable(x: Column | str) -> Column:
    return (F.length(_text(x)) >= 80) | _text(x).rlike(DURABLE)


def stable_id(layer: Column, session: Column, index: Column, role: Column, content: Column) -> Column:
    zero = F.lit("\0")
    joined = F.concat(layer, zero, session, zero, index.cast("string"), zero, role, zero, content)
    return F.concat(F.lit("local:"), layer, F.lit(":"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 24))


def feedback_delta(rating: Column | str) -> Column:
    pairs = F.create_map(*(F.lit(v) for kv in FEEDBACK_DELTA.items() for v in kv))
    return F.coalesce(F.try_element_at(pairs, F.lower(_text(rating))), F.lit(0.0))


def slug(x: Column | str, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_text(x)), "[^a-z0-9-]+", "-"), "^-+|-+$", ""), 1, most)


def assistant_text(x: Column | str) -> Column:
    """Without fenced code; three or more line ends become two."""
    return stripped(F.regexp_replace(F.regexp_replace(_text(x), r"```[^\n]*\n[\s\S]*?```", ""), "\n{3,}", "\n\n"))


def epoch_seconds(x: Column) -> Column:
    """Seconds of an epoch in seconds, or in milliseconds from 1e11 on."""
    return F.when(F.abs(x) >= 1e11, x / 1000.0).otherwise(x)


def safe_name(x: Column | str, fallback: str = "unknown") -> Column:
    """A file name part: other characters than letters, digits, _, . and - become -, 80 characters at most."""
    out = F.substring(F.regexp_replace(F.regexp_replace(stripped(x), "[^A-Za-z0-9_.-]+", "-"), "^[-.]+|[-.]+$", ""), 1, 80)
    return F.when(out == "", fallback).otherwise(out)


def digest_key(prefix: str, width: int, *parts: Column, between: str = "\0") -> Column:
    """prefix and the first `width` hex digits of the SHA-256 of parts, joined."""
    joined = parts[0] if len(parts) == 1 else F.concat_ws(between, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(_text(joined).cast("binary"), 256), 1, width))


def user_namespace(user: Column) -> Column:
    """Prefix of a user's sessions: a digest, from which the user does not follow."""
    return F.concat(digest_key("aml:", 32, user), F.lit(":"))


def content_text(x: Column) -> Column:
    """Text of message content as JSON: a string, an object with text or content, or a list of strings and typed text blocks."""
    at = lambda j, k: F.get_json_object(j, f"$.{k}")
    own = lambda j: F.coalesce(F.nullif(at(j, "text"), F.lit("")), at(j, "content"), F.lit(""))
    part = F.transform(F.from_json(x, "array<string>"), lambda s: F.when(~s.startswith("{"), s).when(at(s, "type").isin("text", "input_text", "output_text"), own(s)))
    return F.when(x.rlike(r"^\s*\["), F.array_join(F.array_compact(part), "\n")).when(x.rlike(r"^\s*\{"), own(x)).otherwise(_text(x))


def redacted_remote(url: Column | str) -> Column:
    """A remote's address without user and password; host and scheme in lower case. Without a scheme what stands behind the first @ stays. Null and empty ones stay."""
    u = F.col(url) if isinstance(url, str) else url
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#]*)(.*)$"
    part = lambda i: F.regexp_extract(u, whole, i)
    plain = F.when(F.contains(u, F.lit("@")), F.regexp_replace(u, r"(?s)^[^@]*@", "")).otherwise(u)
    return F.when(u.rlike(whole), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3))).otherwise(plain)
