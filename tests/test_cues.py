"""Cheap tests before patterns: they never hide a match, and stand-ins give what the patterns gave."""

import random
import re

from pyspark.sql import functions as F

from lexgrain.functions import patterns as P
from lexgrain.functions import text as T
from lexgrain.functions.words import FINITE

ODD = ["ſ", "K", "İ", "ı", "ẞ", "ä", "\U0001f600", "_", "1", ".", ",", " ,", "  ", " ", "\t", "\x1e", "(", "§"]


def test_every_cue_is_found(spark):
    """Each pattern, in any case of letters, is found through its cues just where it is found alone."""
    draw = random.Random(5)
    stems = sorted({w.replace("\\.", ".") for p in P.CUES for w in re.findall(r"[a-zäöüßA-ZÄÖÜ][a-zäöüßA-ZÄÖÜ ]+", p)} | set(FINITE))
    swap = {"s": "ſ", "k": "K", "i": "İ", "ß": "ẞ"}

    def worn(w: str) -> str:
        return "".join(draw.choice([x, x.upper() if len(x.upper()) == 1 else x, swap.get(x, x)]) for x in w)

    rows = [(" ".join(draw.choice([worn(draw.choice(stems)), draw.choice(stems), draw.choice(ODD)]) for _ in range(draw.randrange(1, 7))),) for _ in range(3000)]
    c, low = F.col("t"), T.folded(F.col("t"))
    hidden = [F.count_if(c.rlike(p) & ~T.any_of(low, *cues)).alias(f"h{k}") for k, (p, cues) in enumerate(P.CUES.items())]
    seen = [F.count_if(c.rlike(p)).alias(f"s{k}") for k, p in enumerate(P.CUES)]
    plain = rf"(?iu)(?<![A-Za-z0-9_])(?:{'|'.join(w for w in FINITE if w[0].isascii())})(?![A-Za-z0-9_])"
    verbs = F.count_if(F.regexp_instr(c, F.lit(plain)) != F.regexp_instr(c, F.lit(P.FINITE_VERB))).alias("verben")
    got = spark.createDataFrame(rows, "t string").agg(*hidden, *seen, verbs).first().asDict()
    assert got.pop("verben") == 0 and not any(n for k, n in got.items() if k[0] == "h") and sum(n > 0 for k, n in got.items() if k[0] == "s") >= 6


def test_stand_ins_give_what_the_patterns_gave(spark):
    draw = random.Random(6)
    rows = [("".join(draw.choice([*ODD, "a", "ist", " ", " ", ";", ":", "!", " und", " ", "﻿", "„", "»"]) for _ in range(draw.randrange(0, 12))),) for _ in range(4000)]
    c, S = F.col("t"), T.S
    old = {
        "trim": T.sub(c, rf"\A{S}+|{S}++\z", ""),
        "squash": T.sub(c, rf"{S}{{2,}}|(?! ){S}", " "),
        "n_words": F.size(F.split(c, rf"{S}+")),
    }
    old["span_text"] = T.sub(T.sub(T.sub(T.sub(old["squash"], rf"{S}+([,.:;!?])", "$1"), rf"\A(?:{S}|[,;:])+", ""), rf"(?:{S}|[,;:.])+\z", ""), rf"\A{S}+|{S}++\z", "")
    end = T.sub(T.sub(T.sub(old["squash"], rf",{S}*,+", ","), rf"{S}+([,.;])", "$1"), rf"\A{S}+|{S}++\z", "")
    end = T.sub(T.sub(end, rf"\A[,;:]{S}*", ""), r"[.,;:]\z", "")
    old["clean_span"] = T.sub(T.sub(end, rf"(?iu)[,;]?{S}+(?:wenn|soweit|sofern|falls|und|oder|sowie|dass)\z", ""), rf"\A{S}+|{S}++\z", "")
    wrong = spark.createDataFrame(rows, "t string").agg(*[F.count_if(~getattr(T, name)(c).eqNullSafe(x)).alias(name) for name, x in old.items()]).first().asDict()
    assert set(wrong.values()) == {0}, wrong
