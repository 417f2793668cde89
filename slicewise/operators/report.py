"""Report text and report content rows of scored studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import text as T

MODEL_PHRASE = "a slice classifier (mean AUC 0.986)"


def _pct0(c: Column) -> Column:
    return F.concat(T.fixed(c * 100, 0), F.lit("%"))


def _pct1(c: Column) -> Column:
    """One decimal (``74.4``, ``100.0``) and a percent sign."""
    return T.percent(c)


def report_text(studies: DataFrame, sensitivity: float, specificity: float,
                model: str = MODEL_PHRASE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Paragraph and bullet per study, beside the columns to ``keep``.

    Needs the columns of ``study_scores`` plus ``ppv``, ``npv``, ``prevalence``
    and ``first_hot`` / ``last_hot`` (lowest and highest hot slice index, null
    without hot slices). The study's score is the dominant class's score; a
    positive study without a called subtype shows the score of class any.
    """
    names = [F.when(F.col(f"positive_{c}"), F.lit(K.CLASS_DISPLAY[c])) for c in K.SUBTYPES]
    long_name = F.col("dominant_class")
    listed = F.coalesce(F.nullif(F.concat_ws(", ", *names), F.lit("")), long_name)
    score = F.coalesce(*[F.when(F.col("dominant_key") == c, F.col(f"prob_{c}")) for c in K.SUBTYPES],
                       F.col("prob_any"))
    first, last = F.col("first_hot") + 1, F.col("last_hot") + 1
    place = F.when(F.col("first_hot").isNull(), F.lit("")).otherwise(F.concat(
        F.lit(" Most prominent finding at slice "), first.cast("string"),
        F.when(last != first, F.concat(F.lit("–"), last.cast("string"))).otherwise(F.lit("")), F.lit(".")))
    at = F.concat(_pct0(F.col("prevalence")))
    lead = F.concat(
        F.lit("AI-assisted screening for intracranial hemorrhage (ICH) was performed on the submitted "
              "axial noncontrast CT head series ("), F.col("slice_count").cast("string"),
        F.lit(f" slices) using {model}. "))
    rates = F.lit(f"Sens {sensitivity * 100:.0f}%, Spec {specificity * 100:.0f}%; ")
    pos_par = F.concat(
        lead, F.lit("The study is POSITIVE for suspected "), listed, F.lit(" (model probability "), _pct0(score),
        F.lit("; "), rates, F.lit("PPV "), _pct1(F.col("ppv")), F.lit(" at "), at, F.lit(" local prevalence)."),
        place, F.lit(" This study has been flagged for priority radiologist review. " + K.SCREENING_NOTE))
    neg_par = F.concat(
        lead, F.lit("The study is NEGATIVE for ICH (model probability "), _pct0(F.col("prob_any")),
        F.lit("; "), rates, F.lit("NPV "), _pct1(F.col("npv")), F.lit(" at "), at,
        F.lit(" local prevalence). Routine radiologist read is appropriate. " + K.SCREENING_NOTE))
    pos_bul = F.concat(
        F.lit("• Suspected "), long_name, F.lit(" identified by AI screening (model score "), _pct0(score),
        F.lit(", PPV "), _pct1(F.col("ppv")), F.lit(" at "), at,
        F.lit(" prevalence). Study flagged for priority AI-detected review. " + K.SCREENING_NOTE))
    neg_bul = F.concat(
        F.lit("• No ICH detected by AI screening (NPV "), _pct1(F.col("npv")), F.lit(" at "), at,
        F.lit(" prevalence). Routine read appropriate. " + K.SCREENING_NOTE))
    pos = F.col("overall_positive")
    return studies.select("study_uid", *keep, F.when(pos, pos_par).otherwise(neg_par).alias("paragraph"),
                          F.when(pos, pos_bul).otherwise(neg_bul).alias("bullet"))


def report_sections(texts: DataFrame, column: str = "report") -> DataFrame:
    return texts.select("study_uid", T.report_section(F.col(column), "body").alias("paragraph"),
                        T.report_section(F.col(column), "bullet").alias("bullet"))


def _item(section: str, code: Column | str, scheme: str, meaning: Column | str, kind: str,
          text: Column | None = None, number: Column | None = None, unit: str | None = None) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(scheme).alias("scheme"),
        (F.lit(meaning) if isinstance(meaning, str) else meaning).alias("meaning"), F.lit(kind).alias("type"),
        (text if text is not None else F.lit(None)).cast("string").alias("text"),
        (number if number is not None else F.lit(None)).cast("double").alias("number"),
        F.lit(unit).cast("string").alias("unit"))


def report_items(studies: DataFrame, sensitivity: float, specificity: float, auc: float,
                 model: str = "slice classifier", training: str = "", source: str = "defaults",
                 n_cases: int = 1000) -> DataFrame:
    """Structured report content: one row per item, in document order.

    Same input as :func:`report_text` plus ``hot_slices`` (array of structs) and
    the counts tp / fn / fp / tn, ``pain_index``, the likelihood ratios and
    ``indication``.
    """
    pos = F.col("overall_positive")
    method = [
        _item("method", "111001", "DCM", "Algorithm Name", "TEXT", F.lit(model)),
        _item("method", "111003", "DCM", "Algorithm Version", "TEXT", F.lit(f"Mean AUC {auc:.4f} — {source}")),
        _item("method", "111526", "DCM", "Image Library", "TEXT", F.lit(training)),
        _item("method", "121106", "DCM", "Key Images", "TEXT",
              F.concat(F.lit("Evaluated "), F.col("slice_count").cast("string"), F.lit(" axial NCCT slices")))]
    finding = [_item("finding", "121071", "DCM", "Finding", "TEXT",
                     F.when(pos, F.concat(F.lit("POSITIVE — "), F.col("dominant_class"))).otherwise("NEGATIVE"))]
    for c in K.CLASSES:
        shown = K.CLASS_DISPLAY[c].capitalize()
        call = F.when(F.col(f"positive_{c}"), "POSITIVE").otherwise("negative")
        finding.append(_item("finding", "121071", "DCM", shown, "TEXT", F.concat(
            F.lit(f"{shown}: score "), T.percent(F.col(f"prob_{c}")), F.lit(" ("), call, F.lit(")"))))

    def image(s: Column) -> Column:
        return _item("key_images", s["sop_uid"], "DCM", "Referenced Image", "IMAGE")

    def hot(s: Column) -> Column:
        name = F.coalesce(*[F.when(s["dominant_class"] == c, F.lit(K.CLASS_DISPLAY[c].capitalize())) for c in K.CLASSES])
        return _item("key_images", "112039", "DCM", "Tracking Identifier", "TEXT", F.concat(
            F.lit("Slice "), s["slice_index"].cast("string"), F.lit(" | z="), T.signed_mm(s["slice_z_mm"]),
            F.lit(" | "), name, F.lit(" | score "), T.percent(s["prob"])))

    note = _item("key_images", "121106", "DCM", "Key Images", "TEXT", F.lit(
        "Slices with highest AI activation for detected ICH class. "
        "Spatial localization is approximate (slice-level model)."))
    has_hot = F.size(F.coalesce("hot_slices", F.array())) > 0
    key_images = F.when(has_hot, F.concat(F.array(note), F.flatten(F.transform(
        "hot_slices", lambda s: F.when(s["sop_uid"] != "", F.array(image(s), hot(s))).otherwise(F.array(hot(s)))))))

    prev = _pct0(F.col("prevalence"))
    n = {c: F.col(c).cast("string") for c in ("tp", "fn", "fp", "tn")}

    def pad(c: str) -> Column:
        return F.lpad(n[c], 11, " ")

    table = F.concat(
        F.lit("At assumed prevalence "), prev, F.lit(f", per {n_cases:,} cases:\n\n"),
        F.lit("              AI Positive   AI Negative\n"),
        F.lit("  True ICH    "), pad("tp"), F.lit("   "), pad("fn"), F.lit("   (TP="), n["tp"], F.lit(", FN="), n["fn"],
        F.lit(")\n  No ICH      "), pad("fp"), F.lit("   "), pad("tn"), F.lit("   (FP="), n["fp"], F.lit(", TN="),
        n["tn"], F.lit(")\n"))
    pain = F.concat(
        F.lit("Pain Index (FP:TP ratio) = "), T.fixed(F.col("pain_index"), 2), F.lit(" at "), prev,
        F.lit(" prevalence: for every "), n["tp"],
        F.lit(" true ICH detections, the radiologist must review and override "), n["fp"],
        F.lit(" false positive AI flags. Each override represents additional review time and cognitive load "
              "required to reject an incorrect AI positive call."))
    lr_pos = F.when(F.col("lr_positive") < 1e5, T.fixed(F.col("lr_positive"), 2)).otherwise("∞")
    indication = F.coalesce("indication", F.lit("not specified"))
    performance = [
        _item("performance", "C25429", "NCIt", "Assumed Prevalence", "TEXT",
              F.concat(prev, F.lit(" ("), indication, F.lit(")"))),
        _item("performance", "C0242960", "UMLS", "Metrics Source", "TEXT", F.lit(source)),
        _item("performance", "C41189", "NCIt", "Sensitivity", "NUM", number=F.lit(sensitivity), unit="%"),
        _item("performance", "C41190", "NCIt", "Specificity", "NUM", number=F.lit(specificity), unit="%"),
        _item("performance", "C25651", "NCIt", "Mean AUC", "NUM", number=F.lit(auc), unit="{1}"),
        _item("performance", "C41192", "NCIt", "Positive Predictive Value", "NUM", number=F.col("ppv"), unit="%"),
        _item("performance", "C41194", "NCIt", "Negative Predictive Value", "NUM", number=F.col("npv"), unit="%"),
        _item("performance", "C0392762", "UMLS", "Positive Likelihood Ratio", "TEXT", F.concat(F.lit("LR+ = "), lr_pos)),
        _item("performance", "C0392762", "UMLS", "Negative Likelihood Ratio", "TEXT",
              F.concat(F.lit("LR- = "), T.fixed(F.col("lr_negative"), 4))),
        _item("performance", "C0009401", "UMLS", "Confusion Matrix", "TEXT", table),
        _item("performance", "C0030705", "UMLS", "Pain Index", "TEXT", pain)]
    disclaimer = [_item("disclaimer", "121106", "DCM", "Key Images", "TEXT", F.lit(K.DISCLAIMER))]
    items = F.concat(F.array(*method, *finding), F.coalesce(key_images, F.slice(F.array(note), 1, 0)),
                     F.array(*performance, *disclaimer))
    return (studies.select("study_uid", F.posexplode(items).alias("ord", "i"))
            .select("study_uid", "ord", "i.*"))
