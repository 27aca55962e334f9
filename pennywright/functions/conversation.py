"""Functions over assistant conversations and their usage log."""

from pyspark.sql import Column, functions as F

TOOL_CALLS = "array<struct<name:string,args:map<string,string>>>"


def strip_fence(text: Column) -> Column:
    """Content of a ``` code fence, or the trimmed text without one."""
    body = F.regexp_replace(F.trim(text), r"^```[^\n]*\n", "")
    body = F.regexp_replace(body, r"\n[ \t]*```[ \t]*$", "")
    return F.when(F.trim(text).startswith("```"), body).otherwise(F.trim(text))


def tool_calls(text: Column) -> Column:
    """Calls in a JSON list whose every item has a name; else an empty list."""
    calls = F.from_json(F.trim(text), TOOL_CALLS)
    good = F.trim(text).startswith("[") & F.forall(calls, lambda c: c["name"].isNotNull())
    return F.when(F.coalesce(good, F.lit(False)), calls).otherwise(
        F.array().cast(TOOL_CALLS)
    )


def role_label(role: Column) -> Column:
    """Label of a role; other roles have none and are left out of prompts."""
    return (
        F.when(role == "user", "User")
        .when(role == "assistant", "Assistant")
        .when(role == "tool", "Tool results")
    )


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price per 1,000 tokens; an unknown model costs nothing."""
    amount = tokens_in / 1000 * price_in + tokens_out / 1000 * price_out
    return F.coalesce(amount, F.lit(0.0))


def cache_key(model: Column, system: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|||", model, F.coalesce(system, F.lit("")), prompt), 256)
