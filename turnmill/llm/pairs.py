"""Broken instruction-response pairs and their one kind of defect.

A response that breaks off is the beginning of a longer one. The last line of each response and all sentences are
brought to a common form (numbers and names masked) and sorted by text over the whole table; what a line is a common prefix of are
its next neighbours, and the difference of two running sums counts them: a line that goes on in more responses than it ends was cut.
Peaks in the distribution of lengths show length limits; a line without such neighbours that ends at a limit counts as cut as well.
Copies, refusals and languages are rules on the whole text. Each row is read once; what the later steps need of it is a table in
the shared folder.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

#: A length is a peak if it comes this many times as often as the ten lengths around it do in the middle and as all lengths do on
#: average, beyond SIGMAS deviations of that number.
PEAK, SIGMAS = 3.0, 5.0
#: A line that stands complete in more than this share of its responses was not cut.
COMPLETE = 0.2

# What stands in for nothing.
NOTHING = {
    "", "null", "none", "nil", "nan", "na", "n a", "tbd", "tba", "todo", "empty", "blank", "undefined", "pending", "placeholder", "no response",
    "no answer", "no reply", "not available", "not applicable", "keine antwort", "sin respuesta", "sans réponse", "pas de réponse", "ninguna", "aucune", "keine",
}

# Frequent words by language.
LANGUAGES = {
    "en": """the and you for is it to of with your that this have has on at from will be i we can what was my by are not so here please need want would
        out up do does please agent human someone speak talk refund cancel help hello where who they but which done putting through now tomorrow noon before yes works
        anything else thanks sorry sure happy under without more than""",
    "es": """el los las del que y en un una por con para su se no es lo al más pero como está he mi sus qué quiero muy sobre cuándo dónde hasta desde esta este
        la de me le ya hecho mañana sí ayuda agente hablar alguien gracias debo puedo puede necesito usted hola buenos días disculpe favor nadie vino algo""",
    "fr": """le les des du et est en un une pour par dans vous nous je ne pas que qui sur au avec mon votre ce cette il ai à où été sous depuis l d j n c qu
        la de oui fait demain matin aide conseiller parler quelqu merci bonjour bonsoir dois veux peux chose autre aux ou sans""",
    "de": """der die das und ist ich nicht ein eine den dem von mit für auf zu im es wir sie haben hat am bis was bei ihr einen um vom zum zur als an aus nach
        muss soll wurde werden kann keine hilfe bitte mitarbeiter rückruf ja erledigt morgen vormittag danke hallo guten tag gern geschehen noch sonst dass dieser diese""",
}
_SPEAKS: dict[str, tuple[str, ...]] = {}
for _k, _v in LANGUAGES.items():
    for _w in set(_v.split()):
        _SPEAKS[_w] = (*_SPEAKS.get(_w, ()), _k)
_LETTERS = re.compile(r"[^\W\d_]+")

# Months before which a dot after a number ends nothing.
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_SENTENCE = re.compile(rf"(?<=[.!?…])[\"”»]?\s+(?!(?:{_MONTHS})\b)|[\r\n]+")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»')
_DECLINES = re.compile(
    r"can(?:no|')t help|can(?:no|')t (?:answer|assist|discuss|go into|take part|comment|share|provide)|not able to|unable to|won't be able|will not be able|must decline|have to decline|i decline|"
    r"not something i (?:can|am)|beyond what i can|rules do not let|not allowed to|not permitted|no comment|outside my remit|not be appropriate|leave this unanswered|against (?:our|my) (?:rules|policy)|"
    r"refuse to|no puedo (?:ayudar|tratar|responder|hablar|atender|comentar|contestar)|debo rechazar|tengo que rechazar|no me está permitido|no (?:estoy|tengo) (?:autorizad|permiso)|no sería (?:apropiado|adecuado)|"
    r"ne peux pas (?:vous aider|traiter|répondre|commenter|aborder)|dois refuser|dois décliner|ne suis pas (?:autorisé|en mesure)|pas permis|ne serait pas approprié|"
    r"kann ich (?:dazu )?nicht(?:s)? (?:helfen|sagen|beantworten)|dabei kann ich nicht|kann ich dazu nichts|darf ich (?:leider )?nicht|muss ich (?:leider )?ablehnen|nicht (?:in der lage|befugt|gestattet)|wäre nicht angebracht", re.I)
_CIVIL = re.compile(
    r"^(?:(?:please |bitte |veuillez |por favor )?(?:contact|ask|try|consult|turn|wenden|fragen|consulte|pregunte|contacte|adressez|contactez|demandez)\b.*|.*\b(?:sorry|regret|apolog\w*|understand|désolé|regrette|comprends|lo siento|lamento|entiendo|leid|verstehe)\b[^,;:]*|"
    r"thank you.*|thanks.*|best regards.*|gracias.*|merci.*|danke.*)\W*$", re.I)
_BUT = re.compile(r"\b(?:but|however|pero|mais|aber)\b", re.I)
_DANGLING = re.compile(r"[,:;(\[{/&+\-–—$€£#]$|\(\s*[^)]*$|(?:^|\n)\s*(?:\d+[.)]|[-*•])\s*$|\b(?:am|zum|vom|dem|ab)\s+\d{1,2}\.$", re.I)
_TERMINAL = re.compile(r"[.!?…\"”»“)\]]$")
#: Words no sentence ends with.
_OPEN_WORDS = frozenset("the a an and or of to from with for by will has is in on at que de del la el los las y o con por para en un una et ou le les des du à pour par avec und oder der die das dem den ein eine mit von zu bis um".split())
_MASK_ID = re.compile(r"\b[A-Z]{2,4}-\d+")
_MASK_NAME = re.compile(r"(?<=[^\W_]\s)[A-ZÀ-Þ][\w’'-]*|(?<=[,;:]\s)[A-ZÀ-Þ][\w’'-]*")


_OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Letters and digits only, without case and accents."""
    s = (text or "").casefold()
    return _OTHER.sub("", s if s.isascii() else unicodedata.normalize("NFKD", s))


def says_nothing(text: str | None) -> bool:
    if text is None:
        return True
    s = re.sub(r"<[^<>]{0,60}>", " ", text)
    return " ".join(re.sub(r"[\W_]+", " ", s).casefold().split()) in NOTHING


def language(text: str | None) -> str | None:
    """en, es, fr or de by frequent words outside quotes; None where no language leads."""
    s = _QUOTED.sub(" ", text or "").lower()
    score = dict.fromkeys(LANGUAGES, 0)
    for w in _LETTERS.findall(s if s.isascii() else unicodedata.normalize("NFC", s)):
        for k in _SPEAKS.get(w, ()):
            score[k] += 1
    (n, first), (second, _) = sorted(((n, k) for k, n in score.items()), reverse=True)[:2]
    return first if n > second else None


def is_copy(instruction: str, response: str) -> bool:
    """The instruction again, once or more, after a lead-in at most."""
    a = plain(instruction)
    if not a or len(response) < len(a):
        return False
    b = plain(response)
    if a not in b:
        return False
    rest = b.split(a)
    if not any(rest):
        return True
    # a lead-in: short, without numbers, before the first copy only; next to a terse request anything could be one
    return len(a) >= 20 and not any(rest[1:]) and len(rest[0]) <= 40 and not any(c.isdigit() for c in rest[0])


def declines(response: str) -> bool:
    """Some sentence declines and every other one is mere courtesy or the frame of a quotation."""
    if not _DECLINES.search(response):
        return False
    said = [s for s in _SENTENCE.split(_QUOTED.sub("\0", response)) if s and s.strip(" .\"'\0")]
    no = [(m := _DECLINES.search(s)) is not None and not _BUT.search(s, m.end()) for s in said]
    return any(no) and all(n or _CIVIL.match(s.strip()) or ("\0" in s and len(s.split()) <= 5) for n, s in zip(no, said))


#: Capitalised names of days and months.
_DATES = ("Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
          "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Juni Juli Oktober Dezember").split()
_DATE_CUT = frozenset(d[:k] for d in _DATES for k in range(1, len(d))) - frozenset(_DATES)
_AFTER_DATE = re.compile(r"(?:\d\.?|\bon|\bby|\bam|\bdate) ([^\W\d_]+)$")


def cut_date(response: str) -> bool:
    """Whether the text ends within the name of a day or month."""
    m = _AFTER_DATE.search(response[-60:])  # no name of a day or month is longer
    return m is not None and m[1] in _DATE_CUT


def masked(sentence: str) -> str:
    """Names and numbers brought to one form; the digits of references stay one by one, so a cut one is shorter."""
    s = _MASK_ID.sub(lambda m: "X-" + "0" * (len(m[0]) - m[0].index("-") - 1), sentence.strip())
    s = _MASK_NAME.sub(lambda m: m[0] if m[0].startswith("X-") else "X", s)
    return re.sub(r"(?<![-0])\d[\d.,:]*(?<=\d)", "0", s)


def sentences(response: str) -> list[tuple[str, bool]]:
    """(masked sentence without its end, whether it has an end), in order."""
    out = []
    for s in _SENTENCE.split(response.strip()):
        if s and s.strip():
            end = bool(_TERMINAL.search(s.strip()))
            out.append((masked(s).rstrip(".!?…"), end))
    return out


def rule_defect(instruction: str | None, response: str | None) -> str | None:
    """The defects seen in the pair alone; None if there is none or the instruction is blank."""
    if instruction is None or not instruction.strip():
        return None
    if says_nothing(response):
        return "empty"
    if is_copy(instruction, response):
        return "copied"
    if declines(response):
        return "refusal"
    a, b = language(instruction), language(response)
    if a and b and a != b:
        return "wrong_language"
    return None


_OPEN_NUMBER = re.compile(r"\d\.$")
_LAST_WORD = re.compile(r"\w+$")


def _judged(pairs: DataFrame) -> DataFrame:
    """row_id, defect by rule, last: masked last line if it may be cut, dangling, open, length, lines: masked sentences, text: a name of the response."""
    schema = "row_id long, defect string, last string, dangling boolean, open boolean, length int, lines array<string>, complete array<boolean>, text long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, a, r, name in zip(b["row_id"].tolist(), b["instruction"].tolist(), b["response"].tolist(), b["text"].tolist()):
                asked = a is not None and bool(a.strip())
                d = rule_defect(a if asked else "?", r)
                last, dangling, open_, lines, complete, t = None, False, False, None, None, r.strip() if r else ""
                if r and d in (None, "wrong_language"):
                    s = sentences(t)
                    lines, complete = [x for x, _ in s], [end or k + 1 < len(s) for k, (_, end) in enumerate(s)]
                    if asked:
                        if s and (not s[-1][1] or _OPEN_NUMBER.search(t)):
                            last = s[-1][0]
                        dangling = bool(_DANGLING.search(t)) or cut_date(t)
                        w = _LAST_WORD.findall(t[-40:])
                        open_ = bool(w) and w[0].lower() in _OPEN_WORDS
                out.append((row, d if asked else None, last, dangling, open_, len(t), lines, complete, name))
            yield pd.DataFrame(out, columns=["row_id", "defect", "last", "dangling", "open", "length", "lines", "complete", "text"])

    return pairs.select("row_id", "instruction", "response", F.xxhash64("response").alias("text")).where(F.col("row_id").isNotNull()).mapInPandas(run, schema)


def _inventory(judged: DataFrame) -> DataFrame:
    """line, n, n_complete, copies: the masked sentences and last lines of all different responses that answer, in how many of them, and in how many rows."""
    once = judged.where(F.col("lines").isNotNull()).groupBy("text").agg(F.any_value(F.arrays_zip("lines", "complete")).alias("x"), F.count("*").alias("copies"))
    return (once.select("copies", F.inline("x")).groupBy(F.col("lines").alias("line"))
            .agg(F.count("*").alias("n"), F.count_if("complete").alias("n_complete"), F.sum("copies").alias("copies")))


_END = "\U0010ffff"


def _continued(spark: SparkSession, asked: DataFrame, inventory: DataFrame) -> DataFrame:
    """line, ends, complete, goes_on, ends_rows, goes_on_rows: in how many responses each line ends a sentence, in how many it is the
    beginning of a longer one, and both in rows.

    All lines lie sorted over ranges of the text; a line's longer neighbours stand between it and the last text that could begin
    like it, so two running sums at these places count them. A task streams its range; one pair of sums per range goes to the driver.
    """
    none = F.lit(0).cast("long")
    marks = inventory.select(F.col("line").alias("at"), F.lit(0).alias("kind"), "n", F.col("n_complete").alias("c"), "copies").unionByName(
        asked.select(F.explode(F.array(F.struct(F.col("line").alias("at"), F.lit(1).alias("kind")), F.struct(F.concat("line", F.lit(_END)).alias("at"), F.lit(2).alias("kind")))).alias("x"))
        .select("x.at", "x.kind", none.alias("n"), none.alias("c"), none.alias("copies")))
    cols = ["part", "line", "ends", "complete", "ends_rows", "passed", "passed_rows"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = rows = part = 0
        here: tuple = (None, 0, 0, 0)
        for b in batches:
            out = []
            for at, kind, n, c, m, part in zip(*(b[x].tolist() for x in ("at", "kind", "n", "c", "copies", "part"))):
                total, rows = total + n, rows + m
                if kind == 0:
                    here = (at, n, c, m)
                elif kind == 1:
                    out.append((part, at, *(here[1:] if here[0] == at else (0, 0, 0)), -total, -rows))
                else:
                    out.append((part, at[:-1], 0, 0, 0, total, rows))
            yield pd.DataFrame(out, columns=cols)
        yield pd.DataFrame([(part, None, 0, 0, 0, total, rows)], columns=cols)

    ranged = marks.repartitionByRange("at", "kind").sortWithinPartitions("at", "kind").withColumn("part", F.spark_partition_id())
    passed = written(spark, ranged.mapInPandas(run, "part int, line string, ends long, complete long, ends_rows long, passed long, passed_rows long"), "neighbours")
    sums = {r["part"]: (r["n"], r["rows"]) for r in passed.where(F.col("line").isNull()).groupBy("part").agg(F.sum("passed").alias("n"), F.sum("passed_rows").alias("rows")).collect()}
    before, so_far = [], (0, 0)
    for part in range(max(sums, default=0) + 1):
        before.append(so_far)
        so_far = tuple(x + y for x, y in zip(so_far, sums.get(part, (0, 0))))
    gap = lambda k: F.max(F.get(F.lit([x[k] for x in before]), F.col("part"))) - F.min(F.get(F.lit([x[k] for x in before]), F.col("part")))
    return (passed.where(F.col("line").isNotNull()).groupBy("line")
            .agg(*[F.sum(c).alias(c) for c in ("ends", "complete", "ends_rows")], (F.sum("passed") + gap(0)).alias("goes_on"), (F.sum("passed_rows") + gap(1)).alias("goes_on_rows")))


def _peaks(judged: DataFrame) -> DataFrame:
    """length of each peak among the different responses that may be cut, of all lengths there are."""
    n = judged.where(F.col("last").isNotNull()).select("length", "text").distinct().groupBy("length").agg(F.count("*").alias("n"))
    mean = n.agg(F.avg("n").alias("mean"))
    near = (n.select(F.explode(F.sequence(F.col("length") - 5, F.col("length") + 5)).alias("at"), F.col("length").alias("from"), "n").groupBy("at")
            .agg(F.max(F.when(F.col("at") == F.col("from"), F.col("n"))).alias("own"), F.sort_array(F.collect_list(F.when(F.col("at") != F.col("from"), F.col("n"))), asc=False).alias("around")))
    # of ten numbers, zeros for lengths that do not come, the fifth and sixth are in the middle
    middle = (F.coalesce(F.get("around", F.lit(4)), F.lit(0)) + F.coalesce(F.get("around", F.lit(5)), F.lit(0))) / 2
    usual = PEAK * F.greatest(middle, F.col("mean"), F.lit(1.0))
    return near.crossJoin(F.broadcast(mean)).where(F.col("own") > usual + SIGMAS * F.sqrt(usual)).select(F.col("at").alias("length"), F.lit(True).alias("limit"))


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """row_id, defect: every row with a non-blank instruction whose response is empty, copied, refusal, truncated or
    wrong_language; a row has one at most, the first in this order.

    Rows without row_id and with a blank instruction are never reported; a null response is empty. Rows delivered again
    are judged each by itself, but copies of a response count once among the neighbours; rows decide where responses are as many. An empty table gives no row.
    """
    spark = pairs.sparkSession
    judged = written(spark, _judged(pairs), "judged")
    asked = judged.where(F.col("last").isNotNull()).select(F.col("last").alias("line")).distinct()
    rows = judged.select("row_id", "defect", "last", "dangling", "open", "length")
    rows = rows.join(_continued(spark, asked, _inventory(judged)).withColumnRenamed("line", "last"), "last", "left").join(_peaks(judged), "length", "left")
    alone = (F.col("complete") <= COMPLETE * F.col("ends")) & (F.col("open") | F.coalesce("limit", F.lit(False)))
    cut = F.col("dangling") | F.coalesce(F.struct("goes_on", "goes_on_rows") > F.struct(F.col("ends").alias("goes_on"), F.col("ends_rows").alias("goes_on_rows")), F.lit(False)) | F.coalesce(alone, F.lit(False))
    defect = (F.when(F.col("defect").isin("empty", "copied", "refusal"), F.col("defect")).when(cut, "truncated").otherwise(F.col("defect")))
    return rows.select("row_id", defect.alias("defect")).where(F.col("defect").isNotNull())


def defect_report(pairs: DataFrame) -> DataFrame:
    """Per source and defect: rows."""
    return (pairs.select("row_id", "source").join(broken_pairs(pairs), "row_id").groupBy("source", "defect").agg(F.count("*").alias("rows")))
