"""The whole way from a prompt to a masked text, its mapping and its risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.masking import detected_and_masked, masked_column
from spanveil.functions.matching import Reader, Rule, registered, rule_findings
from spanveil.functions.spans import staged
from spanveil.operators import risk
from spanveil.operators.detect import DEFAULT
from spanveil.operators.dictionary import term_reader, with_terms
from spanveil.operators.mask import STRATEGIES
from spanveil.operators.resolve import apply_overrides


def session_id(id_col: Column, text: Column, salt: str = "") -> Column:
    """The same for the same document and text, so that reruns agree."""
    return F.concat(F.lit("shd_"), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), id_col.cast("string"), text), 256), 1, 16))


#: The version that a processing record names.
ENGINE = "spanveil-1"


def shield(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule | Reader, ...] = DEFAULT, overrides: str | None = None, strategy: str = "REPLACE", salt: str = "", case_exact: bool = False, terms: DataFrame | None = None) -> DataFrame:
    """``docs`` with masked_text, entities, mapping, scores, risk level, verdict and a processing record.

    ``terms`` (term, entity_type, tier) are found beside the rules: without a shuffle up
    to ``dictionary.SMALL`` of them, by a join on the text beyond. A detector that fails
    on a text is named in ``processing.failed`` and adds nothing.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    reader = None if terms is None else term_reader(terms)
    if terms is not None and reader is None:
        docs = with_terms(docs, terms, text, "_terms")
    rules = registered(rules, reader) if reader else rules
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    options = {"strategy": strategy, "salt": salt, "case_exact": case_exact}
    chosen = F.greatest(F.coalesce(F.size(F.col(overrides)), F.lit(0)), F.lit(0)) if overrides else F.lit(0)
    out = docs.withColumn("_chosen", chosen)
    if overrides or "_terms" in out.columns:
        out = staged(out, _found=rule_findings(F.col(text), rules))
        spans = F.concat("_found.spans", "_terms") if "_terms" in out.columns else F.col("_found.spans")
        out = staged(out, _spans=apply_overrides(spans, F.col(overrides), body) if overrides else spans, _failed=F.col("_found.failed"))
        out = staged(out.drop("_found", "_terms"), _m=masked_column(F.col(text), F.col("_spans"), **options)).drop("_spans")
    else:
        out = staged(out, _m=detected_and_masked(F.col(text), rules, **options)).withColumn("_failed", F.col("_m.failed"))
    out = out.select(*[c for c in out.columns if c not in ("_m", "entities", "masked_text", "mapping")], F.col("_m.detected").alias("_detected"), "_m.entities", "_m.masked_text", "_m.mapping")
    out = staged(out, residual_categories=risk.residual_categories(F.col("masked_text")))
    unresolved = F.size("residual_categories") > 0
    out = out.withColumns({"n_entities": F.size("entities"), "privacy_score": risk.privacy_score(F.size("entities"))})
    detectors = F.array(*map(F.lit, dict.fromkeys([r.detector for r in rules] + ["dictionary"] * (terms is not None))))
    return out.withColumns(
        {
            "session_id": session_id(F.col(id_col), body, salt),
            "risk_score": (100 - F.col("privacy_score")).cast("int"),
            "shielded_score": risk.shielded_score(F.col("residual_categories")),
            "risk_level": risk.risk_level(F.col("privacy_score"), unresolved),
            "verdict": risk.verdict(unresolved),
            "decision": F.when(F.size("entities") > 0, "MASKED").otherwise("PASSED"),
            "summary": risk.summary(F.col("entities")),
            "processing": F.struct(
                F.lit(ENGINE).alias("engine_version"), detectors.alias("detectors"), F.col("_detected").alias("entities_detected"), F.col("n_entities").alias("entities_masked"),
                F.col("_chosen").alias("manual_overrides"), F.col("_failed").alias("failed"),
            ),
        }
    ).drop("_failed", "_chosen", "_detected")
