"""What is written on hidden boxes: a placeholder, or its short form, in letters that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import let

# Short forms of types.
SHORT_FORMS = {
    "PASSWORD": "PASS", "API_KEY": "KEY", "CONNECTION_STRING": "CONN", "PROJECT_CODENAME": "PROJ", "PERSON_NAME": "NAME", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE",
    "CREDIT_CARD": "CARD", "BANK_ACCOUNT": "BVN", "IBAN": "IBAN", "SSN_NATIONAL_ID": "NIN", "PASSPORT_NUMBER": "PASSPORT", "SOURCE_CODE_SECRET": "SECRET", "COMPANY_SECRET": "SECRET",
    "ORGANIZATION": "ORG", "REPOSITORY": "REPO", "IP_ADDRESS": "IP", "URL": "URL", "JWT_TOKEN": "JWT", "CUSTOM_TERM": "TERM", "ADDRESS": "ADDR", "LOCATION": "LOC",
    "FINANCIAL_METRIC": "FIN", "EMPLOYEE_ID": "EMP_ID", "CUSTOMER_ID": "CUST_ID", "UUID": "UUID", "MEDICAL_RECORD": "MED", "LEGAL_REFERENCE": "LEGAL", "PRODUCT": "PROD", "EVENT": "EVENT",
    "DATE": "DATE", "DRIVING_LICENCE_NUMBER": "LICENCE", "DRIVING_LICENSE_NUMBER": "LICENSE", "LICENCE_NUMBER": "LICENCE", "LICENSE_NUMBER": "LICENSE", "NATIONAL_INSURANCE_NO": "NIN",
    "NATIONAL_INSURANCE_NUMBER": "NIN", "RELATIONSHIP": "RELATION", "COURT": "COURT", "POINTS": "POINTS", "PROCESSING_REGION": "REGION", "REGION": "REGION",
}
# Width of a letter and height of a line for a size of one, sizes of letters, and widths of boxes that take the short form.
LETTER, LINE, SIZES, NARROW, VERY_NARROW, COMFORTABLE = 0.62, 0.65, (8, 14), 130, 110, 11


def bracketed(placeholder: Column) -> Column:
    return F.concat(F.lit("[["), F.regexp_replace(placeholder, r"^\[*|\]*$", ""), F.lit("]]"))


def short_form(placeholder: Column) -> Column:
    """``[[PASSWORD_001]]`` as ``[[PASS_001]]``; one of another form stays, in brackets."""
    whole = bracketed(placeholder)
    kind, number = (F.regexp_extract(whole, r"^\[\[([A-Z0-9_]+?)_(\d{3,4})\]\]$", k) for k in (1, 2))
    known = F.create_map(*[F.lit(x) for pair in SHORT_FORMS.items() for x in pair])
    return F.when(number == "", whole).otherwise(F.concat(F.lit("[["), F.coalesce(known[kind], kind), F.lit("_"), number, F.lit("]]")))


def _size(text: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(letters that the width allows, letters of the label) in pixels."""
    fits = F.floor(width / F.greatest(F.lit(1.0), F.length(text) * LETTER))
    return fits, F.greatest(F.lit(SIZES[0]), F.least(fits, F.floor(height * LINE), F.lit(SIZES[1])))


def box_label(placeholder: Column, width: Column, height: Column) -> Column:
    """struct<text, font_size>: the placeholder, or its short form on a narrow box if that can be written as large or the box is very narrow."""

    def chosen(texts: Column) -> Column:
        (fits, full), (_, short) = (_size(texts[n], width, height) for n in ("full", "short"))
        shorter = ((width < NARROW) | (fits < COMFORTABLE)) & ((short >= full) | (width < VERY_NARROW))
        return F.struct(F.when(shorter, texts["short"]).otherwise(texts["full"]).alias("text"), F.when(shorter, short).otherwise(full).cast("int").alias("font_size"))

    return let(F.struct(bracketed(placeholder).alias("full"), short_form(placeholder).alias("short")), chosen)


def labelled_boxes(boxes: DataFrame) -> DataFrame:
    """``boxes`` (of ``scans.continued_boxes``) with label; a box that continues another has none."""
    return boxes.withColumn("label", F.when(~F.col("continues"), box_label(F.col("placeholder"), F.col("width"), F.col("height"))))
