"""Line-first cleaning: rules on every line, failing lines go, and documents that lose too much of their text go.

All in DataFrame functions: one pass over the text, no shuffle, nothing outside the JVM.

A line with a word fails by
* punctuation: more than ``SYMBOL_PERCENT`` of its word characters are of ``# * $ % & | < >``, or it has no mark
  that ends a sentence at its end, where quotes and brackets may follow;
* navigation: at least ``SEPARATORS`` of ``| » › • · >``, and more than one to six words;
* boilerplate: at most ``BOILERPLATE_WORDS`` words with a phrase of licences, rights, cookies, logins and the like, in
  English, French, German or Spanish.
Lines without a word are left as they are. A document is kept if it passes the base rules (words, repeated words)
and the lines that failed held at most ``MAX_LOST_PERCENT`` of its word characters.

Repeated three-word windows are found by sorting the document's window hashes (64 bits) with their places.

Cases: null and empty texts have no word and are not kept; texts of any length are read whole; repeated rows give equal
results; null ids are carried along; an empty table gives an empty result; other columns stay as they are, but that
``judged`` puts its column ``quality`` in the place of one of that name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL_PERCENT = 10
SEPARATORS = 3
BOILERPLATE_WORDS = 25
MAX_LOST_PERCENT = 30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL, NOT_SYMBOL = r"[#*$%&|<>]", r"[^#*$%&|<>]+"
SEPARATOR, NOT_SEPARATOR = r"[|»›•·>]", r"[^|»›•·>]+"
SENTENCE_END = r"[.!?…。！？؟।][\"'”’»)\]]*[\x20\x09-\x0D]*\z"
BOILERPLATE = (
    "all rights reserved", "copyright", "©", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie", "enable javascript", "subscribe",
    "newsletter", "click here", "read more", "sign in", "sign up", "log in", "login", "powered by", "lorem ipsum", "share this", "back to top",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "s'abonner", "cliquez ici", "lire la suite", "se connecter", "retour en haut",
    "alle rechte vorbehalten", "impressum", "datenschutz", "nutzungsbedingungen", "abonnieren", "klicken sie hier", "weiterlesen", "anmelden", "nach oben",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "términos de uso", "suscríbete", "haga clic aquí", "leer más", "iniciar sesión", "volver arriba",
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _size_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return _size_without(text, SPACE)


def line_fails(line: Column) -> Column:
    """Whether a line fails a rule; one without a word fails none. Costly counts are taken only where a mark calls for them."""
    dense = line.rlike(SYMBOL) & (_size_without(line, NOT_SYMBOL) * 100 > word_chars(line) * SYMBOL_PERCENT)
    parted = line.rlike(SEPARATOR) & _let(_size_without(line, NOT_SEPARATOR), lambda k: (k >= SEPARATORS) & (k * 6 > F.size(words(line))))
    phrase = (F.size(words(line)) <= BOILERPLATE_WORDS) & _let(F.lower(line), lambda x: reduce(or_, [x.contains(p) for p in BOILERPLATE]))
    return line.rlike(WORD) & (~line.rlike(SENTENCE_END) | dense | parted | phrase)


def repeated_words(held: Column) -> Column:
    """Words (an array) in three-word windows that are found twice or more, the first included."""

    def covered(places: Column) -> Column:
        each = F.transform(places, lambda p, k: F.when(k + 1 < F.size(places), F.least(F.lit(3), F.get(places, k + 1) - p)).otherwise(3))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def among(windows: Column) -> Column:
        same = lambda e, k: F.coalesce((F.get(windows, k - 1)["h"] == e["h"]), F.lit(False)) | F.coalesce((F.get(windows, k + 1)["h"] == e["h"]), F.lit(False))
        return _let(F.sort_array(F.transform(F.filter(windows, same), lambda e: e["i"])), covered)

    def of(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(F.sort_array(placed), among))

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(held) < 3, 0).otherwise(_let(windows(held), of))


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``quality``: the counts, base_failed, lost_chars, kept, and the clean text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n", -1)

    def about_lines(held: Column) -> Column:
        real = F.filter(held, lambda x: x.rlike(WORD))
        return F.struct(
            _let(real, lambda r: F.size(r) - F.size(F.array_distinct(r))).cast("long").alias("n_dup_lines"),
            _let(F.transform(held, lambda x: F.struct(x.alias("line"), line_fails(x).alias("bad"))), about_failures).alias("f"),
        )

    def about_failures(flagged: Column) -> Column:
        none = ~F.exists(flagged, lambda x: x["bad"])
        bad, good = F.filter(flagged, lambda x: x["bad"]), F.filter(flagged, lambda x: ~x["bad"])
        chars = F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + word_chars(x["line"]))
        clean = F.when(none, whole).otherwise(F.array_join(F.transform(good, lambda x: x["line"]), "\n"))
        return F.struct(F.size(bad).cast("long").alias("n"), chars.alias("chars"), clean.alias("clean"))

    def about_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).cast("long").alias("repeats"))

    def verdict(w: Column, x: Column, symbols: Column) -> Column:
        failed = (w["n"] < MIN_WORDS) | (w["repeats"] * 100 > w["n"] * MAX_REPEAT_PERCENT)
        return F.struct(
            w["n"].alias("n_words"), w["chars"].alias("word_chars"), symbols.alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"), w["repeats"].alias("n_repeat_words"),
            failed.alias("base_failed"), x["f"]["n"].alias("n_bad_lines"), x["f"]["chars"].alias("lost_chars"),
            (~failed & (x["f"]["chars"] * 100 <= w["chars"] * MAX_LOST_PERCENT)).alias("kept"), F.when(F.col(text).isNotNull(), x["f"]["clean"]).alias("clean_text"),
        )

    parts = F.struct(_let(words(whole), about_words).alias("w"), _let(lines, about_lines).alias("x"), _size_without(whole, NOT_SYMBOL).cast("long").alias("s"))
    found = _let(parts, lambda p: verdict(p["w"], p["x"], p["s"]))
    # As a generator's output it is computed once, whatever filter or projection follows.
    return docs.withColumn("quality", F.explode(F.array(found)))


def cleaned(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that are kept, without their failing lines; a count of characters follows where there is one."""
    names = docs.columns
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever the columns are called
    found = judged(own, f"c{names.index(text)}").where("quality.kept")
    new = {text: F.col("quality.clean_text"), n_chars: F.length("quality.clean_text")}
    kept = [new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"c{k}") for k, c in enumerate(names)]
    return found.select(*kept).toDF(*names)
