"""``auto_decode`` over a text column: first successful decoder in the fixed order
Base64 -> 0x-hex (6+ digits) -> bare hex -> Morse -> Caesar (first qualifying rotation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.functions import codecs
from tripwire.operators import detectors as D
from tripwire.params import ScanParams


def auto_decode(df: DataFrame, text_col: str = "text", keep=("msg_id",), params: ScanParams = ScanParams()
                ) -> DataFrame:
    keep = list(keep)
    d = df.select(*keep, F.col(text_col).alias("_text"))
    t = F.col("_text")
    d = D._stage(d, _b64c=D.base64_candidates(t),
                 _h0c=F.regexp_extract_all(t, F.lit(D.HEX0X_DECODE_CANDIDATE), 1),
                 _hbr=F.regexp_extract_all(t, F.lit(D.HEX_BARE_CANDIDATE), 1))
    # the bare branch skips odd lengths; no 40/64 exclusion on this path
    d = D._stage(d, _b64=F.call_function("try_element_at", D.base64_decoded(F.col("_b64c")), F.lit(1)),
                 _h0=F.call_function("try_element_at", D.hex_decoded(F.col("_h0c")), F.lit(1)),
                 _hb=F.call_function("try_element_at", D.hex_decoded(
                     F.filter(F.col("_hbr"), lambda h: F.pmod(F.length(h), F.lit(2)) == 0)), F.lit(1)))
    d = D.add_morse(d, params, out="_mor")
    d = D.add_rot_profile(d, out="_rot")
    chi0, chis = F.col("_rot_chi0"), F.col("_rot_chis")
    first_rot = F.call_function("try_element_at", F.filter(
        F.sequence(F.lit(1), F.lit(25)),
        lambda r: (F.element_at(chis, r + 1) < chi0 * 0.4) & (chi0 > 100) & (F.element_at(chis, r + 1) < 35)),
        F.lit(1))
    d = D._stage(d, _r=F.when(chis.isNotNull(), first_rot))
    r = F.col("_r")
    rot_name = F.when(r == 13, F.lit("ROT13")).otherwise(F.concat(F.lit("ROT"), r.cast("string")))
    enc = (F.when(F.col("_b64").isNotNull(), F.lit("Base64")).when(F.col("_h0").isNotNull(), F.lit("Hex (0x)"))
           .when(F.col("_hb").isNotNull(), F.lit("Hex")).when(F.col("_mor_dec").isNotNull(), F.lit("Morse"))
           .when(r.isNotNull(), rot_name))
    plain = F.coalesce(F.col("_b64"), F.col("_h0"), F.col("_hb"), F.col("_mor_dec"),
                       F.when(r.isNotNull(), codecs.rot_n(F.col("_rot_cand"), r)))
    return d.select(*keep, enc.alias("encoding"), plain.alias("plaintext"))
