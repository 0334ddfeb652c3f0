"""Training rows: converters, aligned conversations and preference encodings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

TURN = "struct<role:string,content:string>"


def turn(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def no_turns() -> Column:
    return F.array().cast(f"array<{TURN}>")


def converted(df: DataFrame, questions: list[str], folder: str = "", seed: str = "q") -> DataFrame:
    """id, image and chosen as image_id, image_path and ground_truth, with a question drawn by hash."""
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(len(questions)))
    return df.select(F.col("id").cast("string").alias("image_id"), F.concat(F.lit(folder), "image").alias("image_path"), F.get(F.array(*map(F.lit, questions)), pick.cast("int")).alias("question"), F.col("chosen").alias("ground_truth"))


def trainer_rows(pairs: DataFrame) -> DataFrame:
    """instruction, context, chosen, rejected and images; chosen and rejected under either of their names."""
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in pairs.columns], F.lit(""))
    return pairs.select(F.concat(F.lit("<image>"), "question").alias("instruction"), F.coalesce("context", F.lit("")).alias("context"), first("win", "y_win").alias("chosen"), first("lose", "y_lose").alias("rejected"), F.array("image_path").alias("images"))


def chat_rows(pairs: DataFrame, with_context: bool = True) -> DataFrame:
    """id, image, chosen and rejected conversations; the context, unless empty, goes before both answers."""
    context = F.when(F.coalesce("context", F.lit("")) != "", F.col("context")) if with_context else F.lit(None).cast("string")
    said = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    asked = said("human", F.concat(F.lit("<image>\n"), "question"))
    talk = lambda c: F.array(asked, said("gpt", F.concat_ws(" ", context, F.col(c))))
    return pairs.select(F.col("image_id").cast("string").alias("id"), F.col("image_path").alias("image"), talk("y_win").alias("chosen"), F.when(F.col("y_lose").isNotNull(), talk("y_lose")).alias("rejected"))


def alpaca(df: DataFrame) -> DataFrame:
    """_prompt, _response, _context, _system, _tools from prompt, query, response, history, chosen, rejected, kto_tag."""
    col = lambda c, t="string": F.col(c) if c in df.columns else F.lit(None).cast(t)
    text = lambda c: F.when(col(c) != "", col(c))
    old = F.flatten(F.transform(col("history", "array<struct<prompt:string,response:string>>"), lambda h: F.array(turn("user", h["prompt"]), turn("assistant", h["response"]))))
    prompt = F.concat(F.coalesce(old, no_turns()), F.array(turn("user", F.concat_ws("\n", text("prompt"), text("query")))))
    empty, answer = turn("assistant", F.lit("")), lambda c: turn("assistant", col(c))
    tag = col("kto_tag", "boolean")
    response = (
        F.when(tag, F.array(answer("response"), empty))
        .when(~tag, F.array(empty, answer("response")))
        .when(col("chosen").isNotNull() & col("rejected").isNotNull(), F.array(answer("chosen"), answer("rejected")))
        .when(text("response").isNotNull(), F.array(answer("response")))
        .otherwise(no_turns())
    )
    blank = lambda c: F.coalesce(col(c), F.lit("")).alias(f"_{c}")
    return df.select(*[c for c in ("id",) if c in df.columns], prompt.alias("_prompt"), response.alias("_response"), blank("context"), blank("system"), blank("tools"))


ROLES = {"human": "user", "gpt": "assistant", "observation": "observation", "function_call": "function", "system": "system"}


def sharegpt(df: DataFrame, ranking: bool = False, roles: dict[str, str] | None = None) -> DataFrame:
    """Aligned rows from ``conversations`` of (from, value): a system turn first is split off, users and assistants must
    alternate and pair up; a broken conversation becomes an empty prompt and response, which a later filter drops."""
    roles = ROLES if roles is None else roles
    back = {v: k for k, v in roles.items()}
    odd, even = [back[r] for r in ("user", "observation") if r in back], [back[r] for r in ("assistant", "function") if r in back]
    talk = F.col("conversations")
    has_system = F.coalesce(F.get(talk, F.lit(0))["from"] == back.get("system", "system"), F.lit(False))
    own = F.when(has_system, F.slice(talk, F.lit(2), F.greatest(F.size(talk) - 1, F.lit(0)))).otherwise(talk)
    fits = F.forall(F.transform(own, lambda m, i: F.when(i % 2 == 0, m["from"].isin(*odd)).otherwise(m["from"].isin(*even))), lambda ok: ok)
    sound = F.coalesce(fits, F.lit(True)) & (F.size(own) % 2 == (1 if ranking else 0))
    named = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    turns = F.transform(own, lambda m: turn(F.try_element_at(named, m["from"]), m["value"]))
    if ranking:
        side = lambda c: turn(F.try_element_at(named, F.col(c)["from"]), F.col(c)["value"])
        prompt, response = turns, F.array(side("chosen"), side("rejected"))
    else:
        prompt, response = F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))), F.slice(turns, F.greatest(F.size(turns), F.lit(1)), F.lit(1))
    rest = [c for c in df.columns if c not in ("conversations", "chosen", "rejected", "context", "system", "tools")]
    extra = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")).alias(f"_{c}")
    system = F.when(has_system, F.get(talk, F.lit(0))["value"]).otherwise(F.coalesce(F.col("system"), F.lit("")) if "system" in df.columns else F.lit(""))
    return df.select(*rest, F.when(sound, prompt).otherwise(no_turns()).alias("_prompt"), F.when(sound, response).otherwise(no_turns()).alias("_response"), system.alias("_system"), extra("context"), extra("tools"))


#: Converters by name; more can be registered.
CONVERTERS: dict[str, Callable[..., DataFrame]] = {"alpaca": alpaca, "sharegpt": sharegpt}


def register_converter(name: str, converter: Callable[..., DataFrame]) -> None:
    if name in CONVERTERS:
        raise ValueError(f"converter {name} exists")
    CONVERTERS[name] = converter


def align(df: DataFrame, formatting: str, **options) -> DataFrame:
    if formatting not in CONVERTERS:
        raise ValueError(f"converter {formatting} not found")
    return CONVERTERS[formatting](df, **options)


def valid_pairs(aligned: DataFrame) -> DataFrame:
    return aligned.filter((F.size("_prompt") % 2 == 1) & (F.size("_response") >= 2))


def encode_pairs(df: DataFrame, period: int, cutoff: int = 2048) -> DataFrame:
    """Ids and labels of both answers from prompt, chosen, rejected and context ids: with a context the answers end at
    their last period, and labels count after the context only. The answer's length is cut last.

    In steps, so that no expression repeats another.
    """
    with_context = F.size("context") > 0
    cut = lambda c: F.when(with_context, A.cut_after_last(F.col(c), period)).otherwise(F.col(c))
    df = df.withColumns({c: cut(c) for c in ("chosen", "rejected")})
    longest, room = F.greatest(F.size("chosen"), F.size("rejected")), F.lit(cutoff)
    df = df.withColumns({"_n": F.size("prompt"), "_m": longest})
    n, m = F.col("_n"), F.col("_m")
    share = F.greatest(F.floor(room * m / (n + m)).cast("int"), F.lit(1))
    target = F.when((n + m <= cutoff) | (m * 2 < cutoff), m).when(n * 2 < cutoff, room - n).otherwise(share)
    df = df.withColumn("_m", F.least(target, m)).withColumn("_n", F.least(n, F.greatest(room - F.col("_m"), F.lit(0))))
    head = F.slice("prompt", F.lit(1), F.col("_n"))
    ignored = F.array_repeat(F.lit(-100), F.col("_n"))
    for c in ("chosen", "rejected"):
        df = df.withColumn(c, F.slice(c, F.lit(1), F.least(F.col("_m"), F.size(c))))
        df = df.withColumns({f"{c}_ids": F.concat(head, F.col(c)), f"{c}_labels": F.concat(ignored, F.col(c))})
        df = df.withColumn(f"{c}_labels", F.when(with_context, A.ignore_through(F.col(f"{c}_ids"), F.col(f"{c}_labels"), F.col("context"))).otherwise(F.col(f"{c}_labels")))
    return df.drop("_n", "_m")


def grouped_pairs(pairs: DataFrame, key: str, objects: str, limit: int = -1, order: str = "ord", legacy: bool = False) -> DataFrame:
    """Pairs of a key with the union of their object sets, after a limit on all pairs."""
    from .samplers import first_rows

    rest = [c for c in pairs.columns if c not in (key, objects)]
    kept = first_rows(pairs, limit, order, legacy=legacy)
    return kept.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(objects)))).alias("objects"), F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("pairs"))
