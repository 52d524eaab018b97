"""Text out of raw model responses held in a column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedlake.functions.text import _col, strip, text_or_empty

NO_CHOICE = "no choices in the response"
NO_CONTENT = "the first choice has no message content"
NO_TEXT = "no generated text in the list"
MALFORMED = "not a known response"
EMPTY_TEXT = "the text is blank"


def _result(text: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def _chat(body: Column) -> Column:
    choices = F.get_json_object(body, "$.choices")
    first = F.get_json_object(body, "$.choices[0]")
    content = F.get_json_object(body, "$.choices[0].message.content")
    error = F.when(choices.isNull() | first.isNull(), F.lit(NO_CHOICE)).when(content.isNull(), F.lit(NO_CONTENT))
    return _result(content, error)


def _generation(body: Column, prompt: Column) -> Column:
    in_list = F.get_json_object(body, "$[0].generated_text")
    in_object = F.get_json_object(body, "$.generated_text")
    text = F.coalesce(in_list, in_object)
    echoed = F.startswith(text, prompt)
    rest = strip(F.substr(text, F.length(prompt) + 1))
    reported = F.get_json_object(body, "$.error")
    error = (
        F.when(text.isNotNull(), F.lit(None).cast("string"))
        .when(reported.isNotNull(), reported)
        .when(F.startswith(F.ltrim(body), F.lit("[")), F.lit(NO_TEXT))
        .otherwise(F.lit(MALFORMED))
    )
    return _result(F.when(echoed, rest).otherwise(text), error)


def _canonical(body: Column) -> Column:
    text = strip(text_or_empty(F.get_json_object(body, "$.text")))
    success = F.coalesce(F.get_json_object(body, "$.success") == "true", F.lit(False))
    error = F.when(~success, F.coalesce(F.get_json_object(body, "$.error"), F.lit("unknown error"))).when(
        text == "", F.lit(EMPTY_TEXT)
    )
    return _result(text, error)


def extract_completion(body: Column | str, kind: str, prompt: Column | str | None = None) -> Column:
    """``struct<text, error>`` of a response; exactly one of the two is set.

    ``chat``: first choice's message. ``generation``: ``generated_text`` of a list or an
    object, without the prompt it may repeat. ``canonical``: stripped, non-empty text of a
    successful result.
    """
    body = _col(body)
    if kind == "chat":
        return _chat(body)
    if kind == "generation":
        return _generation(body, F.lit("") if prompt is None else text_or_empty(prompt))
    if kind == "canonical":
        return _canonical(body)
    raise ValueError(f"unknown response kind: {kind}")
