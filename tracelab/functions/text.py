"""Text columns. Patterns are Unicode-aware."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelab.schemas import STATE_FIELDS, VISIBLE_MARKERS

# Patterns that flag a reply.
FIRST_PERSON = r"(?i)\b(i|i'm|i’ve|i've|me|my|mine)\b"
DIRECTIVE = r"(?i)\b(you should|try|consider)\b"
DISCLOSURE_RISK = r"(?i)\b(therapist|doctor|clinician|diagnos\w*|medication|prescri\w*|self-harm|suicide|abuse|crime|trauma|race|religion|sexuality)\b"

STRIPPED = "[\\s\\x1c-\\x1f]"


def strip(text: Column) -> Column:
    """Without white space at the ends, as Unicode has it."""
    return F.regexp_replace(text, rf"(?U)^{STRIPPED}+|{STRIPPED}+\z", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(rf"(?U)[^{STRIPPED[1:-1]}]")), F.lit(False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for a row, however often use names it: optimised plans put expressions in place of columns."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """The different words of a text, lower-cased; apostrophes belong to words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[\w']+\b"), F.lit(0)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def first_words(text: Column, n: int = 4) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def as_prompt(turns: Column) -> Column:
    """role: content, a line for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def chat_messages(turns: Column, system: str) -> Column:
    """A system message, then seekers as users and supporters as assistants."""
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    own = F.transform(turns, lambda t: message(F.when(t["role"] == "seeker", "user").when(t["role"] == "supporter", "assistant"), t["content"]))
    return F.concat(F.array(message(F.lit("system"), F.lit(system))), own)


def recent_window(turns: Column) -> Column:
    """The last turn and, if a supporter's comes right before it, that one."""
    before = F.try_element_at(turns, F.lit(-2))
    return F.when(before["role"] == "supporter", F.slice(turns, -2, 2)).otherwise(F.slice(turns, -1, 1))


def visible_text(state: Column, strategy: Column, response: Column) -> Column:
    """State fields, strategy and reply, each after its marker."""
    parts = [x for f in STATE_FIELDS for x in (F.lit(f"[{f}]"), state[f])]
    return F.concat(*parts, F.lit("[selected_strategy]"), strategy, F.lit("[response]"), response)


def has_marker(value: Column) -> Column:
    return F.exists(F.array(*map(F.lit, VISIBLE_MARKERS)), lambda m: F.contains(value, m))


def visible_reply(text: Column) -> Column:
    """What follows the first reply marker; null if there is none or nothing follows."""

    def own(t: Column) -> Column:
        at = F.position(F.lit("[response]"), t)
        rest = F.substring(t, at + F.lit(len("[response]")), F.length(t))
        return F.when((at > 0) & not_blank(rest), strip(rest))

    return once(text, own)


def visible_problem(text: Column) -> Column:
    """Why a text isn't a sequence of all markers with values, the first problem; null if it is. A value ends at the first next marker."""
    return once(text, _visible_problem)


def _visible_problem(text: Column) -> Column:
    following = (*VISIBLE_MARKERS[1:], None)
    markers = F.array(*(F.struct(F.lit(m).alias("marker"), F.lit(n).cast("string").alias("following")) for m, n in zip(VISIBLE_MARKERS, following, strict=True)))
    say = lambda before, marker, after: F.concat(F.lit(f"visible-SFT {before}"), marker, F.lit(after))

    def step(s: Column, m: Column) -> Column:
        from_ = s["at"] + F.length(m["marker"])
        end = lambda rest: F.when(m["following"].isNull(), F.length(rest) + 1).otherwise(F.position(m["following"], rest))
        return once(F.substring(text, from_, F.length(text)), lambda rest: once(end(rest), lambda e: after(s, m, from_, rest, e)))

    def after(s: Column, m: Column, from_: Column, rest: Column, end: Column) -> Column:
        problem = (
            F.when(F.substring(text, s["at"], F.length(m["marker"])) != m["marker"], say("marker ", m["marker"], " is missing or out of order"))
            .when(end == 0, say("marker ", m["following"], " is missing or out of order"))
            .when(~not_blank(F.substring(rest, F.lit(1), end - 1)), say("value for ", m["marker"], " must not be empty"))
        )
        return F.struct((from_ + end - 1).alias("at"), F.coalesce(s["problem"], problem).alias("problem"))

    start = F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("problem"))
    return F.aggregate(markers, start, step)["problem"]


def fenced_payload(text: Column) -> Column:
    """The content of the one fenced block, if there is exactly one and it parses as JSON; else null."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*\n?(.*?)\n?```"), F.lit(1))
    only = strip(F.try_element_at(blocks, F.lit(1)))
    return F.when((F.size(blocks) == 1) & F.try_parse_json(only).isNotNull(), only)


def reply_kind(text: Column, attempt: Column) -> Column:
    """How a raw reply is taken: object, fenced, broken (looks like JSON or a fence but isn't), retry (first plain text) or plain (a later one)."""
    bare = strip(text)
    parsed = F.try_parse_json(bare)
    is_object = parsed.isNotNull() & F.startswith(bare, F.lit("{"))
    return (
        F.when(is_object, "object")
        .when(fenced_payload(text).isNotNull(), "fenced")
        .when(F.contains(text, F.lit("```")) | F.startswith(bare, F.lit("{")) | F.startswith(bare, F.lit("[")) | (F.length(bare) == 0), "broken")
        .when(attempt <= 1, "retry")
        .otherwise("plain")
    )


def rejection_reason(strategy: Column, response: Column, last_seeker: Column) -> Column:
    """Why a reply of a strategy needs review; null if it doesn't."""
    return (
        F.when((strategy == "Information") & F.rlike(response, F.lit(FIRST_PERSON)), "first-person")
        .when((strategy == "Restatement or Paraphrasing") & F.rlike(response, F.lit(DIRECTIVE)), "directive")
        .when((strategy == "Restatement or Paraphrasing") & ~F.arrays_overlap(tokens(response), tokens(last_seeker)), "no-overlap")
        .when((strategy == "Self-disclosure") & F.rlike(response, F.lit(DISCLOSURE_RISK)), "self-disclosure")
    )
