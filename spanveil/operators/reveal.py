"""Reveal: the values of a session put back into a response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypted_bytes(plain: Column, secret: str) -> Column:
    return F.aes_encrypt(plain, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM"))


def encrypted(mapping: Column, secret: str) -> Column:
    """The mapping as AES-GCM of its JSON, base64."""
    return F.base64(encrypted_bytes(F.to_json(mapping), secret))


def decrypted(stored: Column, secret: str) -> Column:
    plain = F.aes_decrypt(F.unbase64(stored), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")).cast("string")
    return F.from_json(plain, "map<string,string>")


def _pattern(token: Column) -> Column:
    """Any number of brackets and blanks around the bare token, in any case."""
    bare = F.regexp_replace(token, r"^\[\[|\]\]\z", "")
    return F.concat(F.lit(r"(?iu)\[+\s*\Q"), bare, F.lit(r"\E\s*\]+"))


def _tokens(mapping: Column) -> Column:
    """Placeholders, the longest first."""
    return F.array_sort(
        F.map_keys(mapping),
        lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0),
    )


def revealed_text(response: Column, mapping: Column) -> Column:
    quoted = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.when(mapping.isNull(), response).otherwise(F.aggregate(_tokens(mapping), response, lambda out, t: F.regexp_replace(out, _pattern(t), quoted(mapping[t]))))


def revealed_count(response: Column, mapping: Column) -> Column:
    """Placeholders of the session in the response, with repeats."""
    return F.when(mapping.isNull(), 0).otherwise(F.aggregate(_tokens(mapping), F.lit(0), lambda n, t: n + F.regexp_count(response, _pattern(t))))


def reveal(responses: DataFrame, sessions: DataFrame, secret: str, now: Column, response: str = "ai_response") -> DataFrame:
    """(…responses, status, revealed_text, revealed): status is OK, NOT_FOUND, EXPIRED or PURGED.

    ``sessions`` has session_id, encrypted_mappings, expires_at and is_purged.
    """
    met = responses.join(sessions.select("session_id", "encrypted_mappings", "expires_at", "is_purged"), "session_id", "left")
    status = F.when(F.col("encrypted_mappings").isNull() & F.col("expires_at").isNull(), "NOT_FOUND").when(F.col("is_purged"), "PURGED").when(now > F.col("expires_at"), "EXPIRED").otherwise("OK")
    met = met.withColumn("status", status)
    met = met.withColumn("_mapping", F.when(F.col("status") == "OK", decrypted(F.col("encrypted_mappings"), secret)))
    out = met.withColumns({"revealed_text": F.when(F.col("status") == "OK", revealed_text(F.col(response), F.col("_mapping"))), "revealed": revealed_count(F.col(response), F.col("_mapping"))})
    return out.drop("_mapping", "encrypted_mappings", "expires_at", "is_purged")
