"""The four record formats: detection, a common view of their turns, and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim

#: Roles.
CHAT_ROLES = ("system", "user", "assistant", "tool")
SHAREGPT_ROLES = ("system", "human", "gpt", "user", "assistant")
ANSWER_ROLES = ("gpt", "assistant")
TURNS = "array<struct<role:string,field:string,text:string,extra:string>>"
_OBJECT = "map<string,variant>"


def parse_json(raw: Column) -> Column:
    """Variant of exactly one JSON value; null for anything else. Wrapping in brackets shows what trails the value."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, 0))


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _text(v: Column, path: str) -> Column:
    """A string at path; null where it is another type."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(_is_string(x), F.try_variant_get(v, path, "string"))


def _filled(s: Column) -> Column:
    return F.coalesce(s != "", F.lit(False))


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def detect(v: Column) -> Column:
    """Strict classification of a parsed record; null if it is none of the four."""

    def turns(path: str, role: str, text: str, roles: tuple[str, ...]) -> Column:
        items = _items(v, path)
        good = lambda x: F.coalesce(_text(x, f"$.{role}").isin(*roles), F.lit(False)) & _filled(_text(x, f"$.{text}"))
        return F.coalesce((F.size(items) > 0) & F.forall(items, good), F.lit(False))

    last = F.element_at(_items(v, "$.conversations"), -1)
    given = F.try_variant_get(v, "$.input", "variant")
    return (
        F.when(turns("$.messages", "role", "content", CHAT_ROLES), "chat")
        .when(_filled(_text(v, "$.prompt")) & _filled(_text(v, "$.completion")), "prompt-completion")
        .when(_filled(_text(v, "$.instruction")) & _filled(_text(v, "$.output")) & (given.isNull() | F.is_variant_null(given) | _is_string(given)), "alpaca")
        .when(turns("$.conversations", "from", "value", SHAREGPT_ROLES) & F.coalesce(_text(last, "$.from").isin(*ANSWER_ROLES), F.lit(False)), "sharegpt")
    )


def detect_loosely(v: Column) -> Column:
    """By the presence of keys only."""
    there = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return (
        F.when(F.coalesce(F.size(_items(v, "$.messages")) > 0, F.lit(False)), "chat")
        .when(there("prompt") & there("completion"), "prompt-completion")
        .when(there("instruction") & there("output"), "alpaca")
        .when(there("conversations"), "sharegpt")
    )


def turns(v: Column, fmt: Column) -> Column:
    """Text fields in order: role, field, text, and whatever else a turn carries as canonical JSON."""

    def listed(path: str, role: str, text: str) -> Column:
        rest = lambda x: F.to_json(F.map_filter(F.try_variant_get(x, "$", _OBJECT), lambda k, _: ~k.isin(role, text)))
        return F.transform(_items(v, path), lambda x: F.struct(_text(x, f"$.{role}").alias("role"), F.lit(text).alias("field"), _text(x, f"$.{text}").alias("text"), rest(x).alias("extra")))

    def field(name: str, role: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(name).alias("field"), _text(v, f"$.{name}").alias("text"), F.lit("{}").alias("extra"))

    alpaca = F.filter(F.array(field("instruction", "user"), field("input", "user"), field("output", "assistant")), lambda t: t.text.isNotNull())
    return (
        F.when(fmt == "chat", listed("$.messages", "role", "content"))
        .when(fmt == "sharegpt", listed("$.conversations", "from", "value"))
        .when(fmt == "prompt-completion", F.array(field("prompt", "user"), field("completion", "assistant")))
        .when(fmt == "alpaca", alpaca)
        .cast(TURNS)
    )


def rest_of_record(v: Column) -> Column:
    """Keys besides the text fields, as canonical JSON: part of what makes two records equal."""
    own = ("messages", "conversations", "prompt", "completion", "instruction", "input", "output")
    return F.to_json(F.map_filter(F.try_variant_get(v, "$", _OBJECT), lambda k, _: ~k.isin(*own)))


def required(turns: Column) -> Column:
    return F.filter(turns, lambda t: t.field != "input")


def folded(role: Column) -> Column:
    """One role name for all formats."""
    return F.when(role.isin("human", "user"), "user").when(role.isin("gpt", "assistant"), "assistant").otherwise(role)


def merge_same_role(turns: Column) -> Column:
    """Consecutive turns of one role become one, joined by a newline; the first one's tags stay."""
    empty = F.expr(f"cast(array() as {TURNS})")

    def step(done: Column, t: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last.role.alias("role"), last.field.alias("field"), F.concat(last.text, F.lit("\n"), t.text).alias("text"), last.extra.alias("extra"))
        same = (F.size(done) > 0) & (folded(last.role) == folded(t.role))
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(t)))

    return F.aggregate(turns, empty, step)


def ends_on_answer(turns: Column, fmt: Column) -> Column:
    return F.when(fmt.isin("chat", "sharegpt"), F.element_at(turns, -1).role.isin(*ANSWER_ROLES)).otherwise(True)


def messages(turns: Column, fmt: Column) -> Column:
    """Turns of any format as role and content."""
    plain = F.transform(turns, lambda t: F.struct(folded(t.role).alias("role"), t.text.alias("content")))
    part = lambda name: F.get(F.filter(turns, lambda t: t.field == name), 0).text
    extra = F.coalesce(part("input"), F.lit(""))
    asked = F.when(trim(extra) != "", F.concat(part("instruction"), F.lit("\n\n"), extra)).otherwise(part("instruction"))
    pair = F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")), F.struct(F.lit("assistant").alias("role"), part("output").alias("content")))
    # Of several system turns the first is kept, in front.
    system = F.slice(F.filter(plain, lambda m: m.role == "system"), 1, 1)
    shared = F.concat(system, F.filter(plain, lambda m: m.role != "system"))
    return F.when(fmt == "alpaca", pair).when(fmt == "sharegpt", shared).otherwise(plain)


def to_record(v: Column, fmt: Column, turns: Column) -> Column:
    """JSON of a record with its text replaced by turns; other keys stay."""
    item = lambda role, text: F.transform(
        turns, lambda t: F.map_concat(F.from_json(t.extra, _OBJECT), F.create_map(F.lit(role), F.try_parse_json(_quoted(t.role)), F.lit(text), F.try_parse_json(_quoted(t.text))))
    )
    array = lambda role, text: F.concat(F.lit("["), F.array_join(F.transform(item(role, text), lambda m: F.to_json(m)), ","), F.lit("]"))
    flat = F.map_from_entries(F.transform(turns, lambda t: F.struct(t.field.alias("key"), F.try_parse_json(_quoted(t.text)).alias("value"))))
    whole = F.try_variant_get(v, "$", _OBJECT)
    kept = lambda *names: F.map_filter(whole, lambda k, _: ~k.isin(*names))
    made = (
        F.when(fmt == "chat", F.map_concat(kept("messages"), F.create_map(F.lit("messages"), F.try_parse_json(array("role", "content")))))
        .when(fmt == "sharegpt", F.map_concat(kept("conversations"), F.create_map(F.lit("conversations"), F.try_parse_json(array("from", "value")))))
        .otherwise(F.map_concat(F.map_filter(whole, lambda k, _: ~F.exists(turns, lambda t: t.field == k)), flat))
    )
    return F.to_json(made)


def _quoted(s: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r'(?s)^\{"x":(.*)\}\z', 1)


def instruction_flags(messages: Column) -> Column:
    """Reasons to think that the last message doesn't answer."""
    answer = F.trim(F.element_at(messages, -1).content)
    asked = F.trim(F.array_join(F.transform(F.slice(messages, F.lit(1), F.size(messages) - 1), lambda m: m.content), ""))
    a, p = F.length(answer), F.length(asked)
    no_answer = (F.size(messages) == 0) | F.coalesce(F.element_at(messages, -1).role != "assistant", F.lit(True))
    flags = F.array(
        F.when((a < 4) & (p > 30), "answer_too_short"),
        F.when(answer.rlike(r"[?\x{FF1F}]\z") & (a < 50), "answer_is_question"),
        F.when((p > 50) & (a / p < 0.03), "answer_ratio_too_low"),
    )
    return F.when(no_answer, F.array(F.lit("no_assistant_answer"))).otherwise(F.filter(flags, lambda x: x.isNotNull()))


def chat_records(conversations: DataFrame) -> DataFrame:
    """A table conv_id, turn, role, text as chat records, one a conversation, in the order of turns."""
    made = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turn = lambda t: F.struct(t.role.alias("role"), F.lit("content").alias("field"), t.text.alias("text"), F.lit("{}").alias("extra"))
    return made.select(F.col("conv_id").alias("line_no"), F.lit("chat").alias("format"), F.lit("").alias("source"), F.transform("t", turn).cast(TURNS).alias("turns"), F.lit("{}").alias("rest"))


def text_records(docs: DataFrame, key: str, text: str, source: str | None = None) -> DataFrame:
    """A table of texts as records with one text field."""
    one = F.array(F.struct(F.lit("user").alias("role"), F.lit("text").alias("field"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit("{}").alias("extra"))).cast(TURNS)
    tag = F.coalesce(F.col(source), F.lit("")) if source else F.lit("")
    return docs.select(F.col(key).alias("line_no"), F.lit("text").alias("format"), tag.alias("source"), one.alias("turns"), F.lit("{}").alias("rest"))


