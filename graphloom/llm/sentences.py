"""Sentence boundaries by cascading tables of break and no-break rules.

A rule is a pair of regular expressions, for the text before and after a position, and says break or no
break. At each position that could end a sentence the tables are tried in order - those of the
languages found in the text, by their votes (all of them where no word votes), then those of its scripts, then the common one - and the first
rule whose pair matches decides. A table is compiled into one alternation of its rules. Blank lines always end a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAK, NO_BREAK = True, False
_CLOSE = r"[\"'”’»)\]」』）〉》“‘]"
_LATIN_END = rf"[.!?…؟]+(?:{_CLOSE}|[\s ]»)*"
#: Positions that could end a sentence: after an end mark with its closing quotes; with Thai also at white space next to Thai words.
_MARKS = rf"(?:{_LATIN_END}|[。！？।॥｡]+[”’」』）»\"]*)"
CANDIDATE = regex.compile(_MARKS)
CANDIDATE_THAI = regex.compile(rf"{_MARKS}|(?<=[\u0e00-\u0e7f\d%\"”»)])(?=\s+[\u0e00-\u0e7f\p{{Lu}}“\"«(])|(?<=[\p{{L}}\d])(?=\s+[\u0e00-\u0e7f])")
BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])(?:[^\S\r\n]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]))+|[\u2029]")
_SPACE = r"[\s\u200b\ufeff]"
_OPEN = r"[\"'“”‘„«¿¡(\[「『]"
# What a new sentence may begin with, whatever the language: an opening quote, a capital or a script without case.
_NEXT = rf"{_SPACE}+{_OPEN}*(?:\p{{Lu}}|\p{{Lt}}|\p{{Lo}}|\d)"


def _words(*words: str) -> str:
    return "|".join(regex.escape(w).replace("\\ ", rf"{_SPACE}*") for w in sorted(words, key=len, reverse=True))


# Words that open a sentence and are hardly part of a name, by language: articles, pronouns, question words, conjunctions, prepositions, adverbs, titles.
STARTERS = {
    "en": "A About Above After Afterwards All Also Although Among An And Another Any Anyone Are As At Because Before Below Between Both But By Can Did Do Does During Each Either Even Every Everyone Few Finally For From Given He Hence Her Here His How However I If In Indeed Instead Is It Its Last Later Many Meanwhile More Moreover Most Much My Neither Never Next No Nobody None Nor Nothing Now Of On Once One Only Or Other Otherwise Our Over Please See Several She Since So Some Somebody Someone Soon Still Such That The Their Then There Therefore These They This Those Though Thus To Today Two Under Until Was We What When Where Which While Who Whoever Why With Within Without Yet You Dr Mr Mrs Ms Prof".split(),
    "de": "Aber Alle Als Also Am An Auch Auf Aus Bei Beide Bis Da Dabei Dadurch Daher Damit Danach Dann Das Dazu Denn Der Die Dies Diese Dieser Dieses Doch Dort Durch Ein Eine Einer Er Erst Es Etwa Für Gegen Hier Ich Ihr Im In Ist Jede Jeder Jedes Jetzt Kein Keine Man Manche Mit Nach Nicht Nichts Niemand Noch Nun Nur Ob Oder Ohne Sein Seine Seit Sie So Sobald Später Trotz Über Um Und Unter Viele Vom Von Vor Wann Warum Was Weil Weiter Wenn Wer Wie Wir Wo Zu Zuletzt Zum Zur Zwischen Dr Frau Herr Prof".split(),
    "fr": "À Afin Ainsi Alors Après Au Aucun Aucune Aussi Avant Avec Ce Cela Celui Cependant Ces Cet Cette Ceux Chacun Chaque Chez Comme Comment Dans De Depuis Des Dès Donc Du Elle Elles En Enfin Ensuite Est Et Il Ils Je La Le Les Leur Lors Mais Même Nous On Or Où Ou Par Pendant Plus Plusieurs Pour Pourquoi Puis Quand Que Quel Quelle Qui Sa Sans Selon Si Son Sous Sur Tous Tout Toute Toutes Très Un Une Vers Vous Dr M Mme".split(),
    "es": "A Ahora Al Algunos Allí Antes Aquí Así Aún Aunque Bajo Cada Casi Como Con Contra Cuál Cuando Cuándo De Desde Después Donde Dónde El Él Ella Ellos En Entonces Entre Es Esa Ese Esta Está Este Esto Estos Hasta Hay La Las Lo Los Luego Mas Más Mientras Mucho Muchos Muy Nada Nadie Ni Ningún Ninguna No Nunca O Otra Otro Para Pero Poco Por Porque Pues Qué Que Quién Se Según Si Sí Siempre Sin Sobre Solo Su Sus También Tampoco Tanto Toda Todas Todo Todos Tras Un Una Unos Y Ya Yo Dr Dra Sr Sra".split(),
    "it": "A Al Alcuni Allora Anche Ancora Appena Che Chi Ci Ciascuno Come Con Contro Così Da Dal Dei Del Della Di Dopo Dove E È Ecco Essa Esso Fino Già Gli I Il In Infine Io L La Le Lo Loro Ma Mentre Molti Molto Ne Nel Nella Nessun Nessuna Nessuno Niente Noi Non Ogni Ognuno Oggi Ora Per Perché Però Più Poi Prima Qual Quale Quando Quanto Quella Quello Questa Questo Qui Quindi Se Sebbene Senza Si Sono Sotto Sua Sui Suo Tale Tra Tutte Tutti Un Una Uno Dott Sig".split(),
}
_START = rf"{_SPACE}*(?:[\"“„«¿¡]|(?:{'|'.join(sorted({w for s in STARTERS.values() for w in s}, key=len, reverse=True))})(?!\w)|[Ll][’']|\p{{Lo}}|\d)"

# Abbreviations after which the sentence goes on, before a number only, and those that may also end it.
ONWARD = {
    "en": ("Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Rev", "Gen", "Col", "Hon", "e.g", "i.e", "viz", "cf", "vs", "approx", "incl", "excl", "resp", "esp", "Messrs"),
    "de": ("Dr", "Prof", "Hr", "Fr", "z. B", "d. h", "u. a", "i. d. R", "i. S. v", "o. ä", "s. o", "s. u", "u. U", "bzw", "vgl", "ca", "ggf", "inkl", "evtl", "sog", "gem", "insb", "Mio", "Mrd", "Dipl", "Ing", "Fa", "geb", "verh", "Hrsg", "Tel", "Str"),
    "fr": ("M", "MM", "Mme", "Mlle", "Dr", "Pr", "Me", "p. ex", "c.-à-d", "cf", "env", "éd", "av"),
    "es": ("Sr", "Sra", "Sres", "Srta", "Dr", "Dra", "D", "Dña", "Prof", "Lic", "Ing", "p. ej", "aprox", "cf", "Ud", "Uds"),
    "it": ("Sig", "Sig.ra", "Dott", "Dott.ssa", "Prof", "Ing", "Avv", "p. es", "ad es", "cfr", "ca"),
}
NUMBERED = {
    "en": ("No", "Nos", "Sec", "Secs", "Ch", "Cl", "Fig", "Figs", "Art", "Arts", "p", "pp", "Vol", "Eq", "Tab", "App", "para", "art", "sec", "fig", "ch", "cl", "no", "Reg", "Para"),
    "de": ("Nr", "Art", "Abs", "Ziff", "S", "Kap", "Bd", "Abb", "Tab", "Rn", "Anm", "lit", "Satz", "Nrn", "Anh"),
    "fr": ("art", "al", "p", "pp", "n", "nº", "no", "chap", "fig", "vol", "ann", "tab", "sect"),
    "es": ("art", "arts", "núm", "núms", "pág", "págs", "cap", "caps", "fig", "vol", "n", "inc", "apdo", "párr", "tab", "sec"),
    "it": ("art", "artt", "n", "pag", "pagg", "cap", "fig", "vol", "c", "comma", "lett"),
}
EITHER = {
    "en": ("etc", "Inc", "Ltd", "Corp", "Co", "a.m", "p.m", "et al", "ff", "Bros", "Dept", "Est", "Ave"),
    "de": ("usw", "etc", "ff", "u. Ä", "Co", "e. V", "f"),
    "fr": ("etc", "Cie", "sq", "Co"),
    "es": ("etc", "Cía", "EE. UU", "S.A", "Ltda", "a. m", "p. m"),
    "it": ("ecc", "S.p.A", "S.r.l"),
}
for _listed in (ONWARD, NUMBERED):  # any of them may also open a sentence
    for _lang, _short in _listed.items():
        _listed[_lang] = (*dict.fromkeys((*_short, *(a[0].upper() + a[1:] for a in _short if len(a) > 2))),)
# Last words of the abbreviations, and small Roman numbers: after any other word of three letters or more no rule comes before the common break.
_LAST = {a.split(" ")[-1].split(".")[-1] for t in (ONWARD, NUMBERED, EITHER) for v in t.values() for a in v} | {"iii", "vii", "viii", "xii", "xiii", "xvi", "xiv", "xix", "xxi", "xxx"}
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Frequent words that tell the Latin-script languages apart.
VOTES = {
    "en": "the each every is of and for shall should may must needs to any by with from it this that are was not".split(),
    "de": "der die das den des und ist soll muss darf kann nicht jede für nach wer im er es ein eine mit von zu auf in".split(),
    "fr": "le les des du doit peut devrait est et pour dans qui une au chaque il elle la un ne pas".split(),
    "es": "el los las del debe puede debería es para después quién cada sin un al la una y en se no".split(),
    "it": "il gli della deve può dovrebbe è di che per ogni nel la un una e non si".split(),
}
_VOTERS = {w: tuple(k for k, v in VOTES.items() if w in v) for v in VOTES.values() for w in v}
_LETTERS = re.compile(r"[^\W\d_]+")
_B = r"(?<![\p{L}\p{M}\d])(?<!(?<!\p{L})\p{L}\.)"
# What an acronym with points may qualify.
BODIES = "Board|Committee|Council|Agency|Commission|Authority|Office|Bureau|Government|Department|Ministry|Court|Group|Panel|Secretary|Senate|Congress|Army|Navy|Act|Code|Standard|Union|Institute|University|Treaty|Programme|Program"
TITLES = _words("Dr", "Mr", "Mrs", "Ms", "Prof", "M", "MM", "Mme", "Mlle", "Sr", "Sra", "Dra", "Hr", "Fr", "Herr", "Frau", "Sig", "Dott", "Me", "Pr", "St")

#: (break?, before, after) in the order in which they are tried.
Rule = tuple[bool, str, str]
TABLES: dict[str, list[Rule]] = {}
# A class or annex named by a letter, before all languages: the letter is no abbreviation there.
TABLES["labels"] = [
    (BREAK, rf"(?i:\b(?:class|classe|clase|klasse|annex|annexe|anexo|anhang|appendix|type|tipo|typ|part|parte|partie|teil|group|grupo|gruppe|groupe|level|stufe|system|option|plan|block|vitamin|zone|zona|phase|fase|table|figure|section|sección|abschnitt|room|raum|gate|line|linie|grade|category|kategorie|case|fall|point|punkt|schedule|module|modul|version|variant|variante|scenario|szenario))s?{_SPACE}+\p{{Lu}}[.!?…]+{_CLOSE}*", rf"{_SPACE}*{_OPEN}*[\p{{Lu}}\p{{Lo}}\d]"),
]
for _lang in VOTES:
    TABLES[_lang] = [
        (NO_BREAK, rf"{_B}(?:{_words(*ONWARD[_lang])})\.", rf"{_SPACE}*\S"),
        (NO_BREAK, rf"{_B}(?:{_words(*NUMBERED[_lang])})\.", rf"{_SPACE}*(?:\d|[IVXLC]+\b|ex\.|ej\.|es\.)"),
        (BREAK, rf"{_B}(?:{_words(*EITHER[_lang])})\.{_CLOSE}*", rf"{_SPACE}+{_OPEN}*(?:\p{{Lu}}|\p{{Lo}}|\d)|{_OPEN}*(?:\p{{Lo}}|\p{{Lu}}\p{{Ll}}|\p{{Lu}}{_SPACE})"),
        (NO_BREAK, rf"{_B}(?:{_words(*EITHER[_lang])})\.{_CLOSE}*", r""),
    ]
TABLES["de"].insert(0, (NO_BREAK, r"(?<!\d)\d{1,2}\.", rf"{_SPACE}+(?:{MONTHS})"))
TABLES["ar"] = [
    (NO_BREAK, r"(?<![\p{L}\p{M}])(?:د|أ|م|ص|ج|ت|هـ|ق)\.", r""),
    (NO_BREAK, r"[؟?!.]+[»”\"]", rf"{_SPACE}+(?:ثم|و(?=\p{{L}})|قبل أن|بعد أن)"),
    (NO_BREAK, r"[؟?!.]+[»”\"]", rf"{_SPACE}*[،؛,]"),
    (BREAK, rf"[.!؟…]+{_CLOSE}*", rf"{_SPACE}+{_OPEN}*\p{{Arabic}}"),
]
TABLES["hi"] = [
    (NO_BREAK, r"(?<![\p{L}\p{M}])(?:डॉ|श्री|प्रो|कु|सं|क्र|पृ|रु|[\p{L}\p{M}]{1,2})\.", r""),
    (NO_BREAK, r"[।?!.]+[”’\"]", rf"{_SPACE}*(?:और|पर|फिर|यह|ऐसा|के|का|की|को|पूछ|कह|तथा|से|में|वाल)[\p{{M}}\p{{L}}]*"),
    (BREAK, rf"[।॥]+{_CLOSE}*", r""),
]
_QUOTE_ON = r"(?:と|って|という|との|や|を|が|は|に|の|も|で)"
TABLES["ja"] = [
    (NO_BREAK, r"[。！？｡!?]+[」』”’）]+", rf"{_SPACE}*(?:{_QUOTE_ON}|、|，|か|な)"),
    (BREAK, r"[。！？｡]+[」』”’）]*", r""),
]
TABLES["zh"] = [
    (NO_BREAK, r"[。！？!?]+[”’」』）]+", rf"{_SPACE}*(?:之后|后|之|是|的|这|该|并|然后|来|时|为|等|与|和|及|而|就|便|再|才|也|都|，|；|、|。|一|作为|写|说|问|则)"),
    (BREAK, r"[。！？]+[”’」』）]*", r""),
]
_TH = r"[\u0e00-\u0e7f]"
TABLES["th"] = [
    (NO_BREAK, rf"{_TH}\.", rf"{_SPACE}*[{_TH[1:-1]}\d]"),
    (NO_BREAK, rf"{_TH}", rf"{_SPACE}+(?:ๆ|ฯ|และ|หรือ|แต่|เพราะ|เพื่อ|ซึ่ง|โดย|ที่|เมื่อ|จึง|ก็)"),
    (NO_BREAK, r"[\d%]", rf"{_SPACE}+{_TH}"),
    (NO_BREAK, r"[\p{Lu}\p{Ll}]", rf"{_SPACE}+{_TH}"),
    (BREAK, rf"{_TH}[\"”»)]*", rf"{_SPACE}+[“\"«(]*(?:{_TH}|\p{{Lu}}\p{{Ll}}|\p{{Lu}}{_SPACE})"),
    (BREAK, rf"[.!?…]+{_CLOSE}*", rf"{_SPACE}+{_TH}"),
]
TABLES["common"] = [
    # Numbers, versions, addresses and abbreviations written together.
    (NO_BREAK, r"\d\.", r"\d"),
    (NO_BREAK, r"(?:^|[\n\r])[^\S\n\r]*(?:\(?\d{1,3}(?:\.\d+)*|\(?[a-zA-Z]|[ivx]+)\.", rf"{_SPACE}+\S"),
    # The sentence goes on: a small letter or a mark that cannot begin one.
    (NO_BREAK, rf"[.!?…؟]+(?:{_CLOSE}|{_SPACE}»)*", rf"{_SPACE}*[,;:،؛、，；：)\]}}»–—-]"),
    (NO_BREAK, rf"[.!?…؟]+(?:{_CLOSE}|{_SPACE}»)*", rf"{_SPACE}+{_OPEN}?\p{{Ll}}"),
    (NO_BREAK, r"[.!?…]+", r"[\p{Ll}\d_@/&=%+-]"),
    # Initials of a name.
    (NO_BREAK, rf"{_B}(?:{TITLES})\.?{_SPACE}+(?:\p{{Lu}}\.[{_SPACE[1:-1]}-]?)+", rf"{_SPACE}*-?\p{{Lu}}"),
    (NO_BREAK, r"(?:\p{Lu}\.){2,}", rf"{_SPACE}+(?:{BODIES})\b"),
    (BREAK, rf"(?:\p{{Lu}}\.){{2,}}{_CLOSE}*", rf"{_SPACE}*{_OPEN}*(?:\p{{Lu}}\p{{Ll}}|\p{{Lu}}{_SPACE}|\p{{Lo}})|{_SPACE}+{_OPEN}*[\p{{Lu}}\d]"),
    (NO_BREAK, r"(?:\p{Lu}\.){2,}", r""),
    (NO_BREAK, r"(?<![\p{L}\d])\p{Lu}\.-?", r"\p{Lu}\."),
    (BREAK, rf"(?<=\p{{Ll}}{_SPACE}+)\p{{Lu}}[.!?…]+{_CLOSE}*", _START),
    (NO_BREAK, r"(?<![\p{L}\d])\p{L}\.", rf"{_SPACE}*-?\p{{Lu}}"),
    # Ends.
    (BREAK, rf"[.!?…؟]+(?:{_CLOSE}|{_SPACE}»)*", _NEXT),
    (BREAK, rf"[\p{{L}}\p{{M}}\d%)”»\"{_SPACE[1:-1]}][.!?…؟]+(?:{_CLOSE}|{_SPACE}»)*", rf"{_OPEN}*(?:\p{{Lu}}|\p{{Lo}})"),
    (BREAK, rf"[!?؟]+(?:{_CLOSE}|{_SPACE}»)*", rf"{_SPACE}+\S"),
    (BREAK, r"[।॥。！？]+[”’」』]*", r""),
]
SCRIPTS = {"ar": r"\p{Arabic}", "hi": r"\p{Devanagari}", "ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "th": r"\p{Thai}"}
_SCRIPT = {k: regex.compile(v) for k, v in SCRIPTS.items()}
_ANY_SCRIPT = regex.compile("[" + "".join(v.strip("[]") for v in SCRIPTS.values()) + "]")
_SOLID = regex.compile(r"[\p{L}\p{N}\p{S}]")


@lru_cache(maxsize=None)
def _table(name: str) -> tuple[regex.Pattern, tuple[bool, ...]]:
    """The rules of a table as one pattern, the group that matched being the number of the first rule that does, and what each rule says."""
    return regex.compile("|".join(rf"(?<={before})(?={after})()" if after else rf"(?<={before})()" for _, before, after in TABLES[name])), tuple(r[0] for r in TABLES[name])


def breaks(cascade: list[tuple[regex.Pattern, tuple[bool, ...]]], text: str, at: int) -> bool:
    """What the first rule that matches says of the position."""
    for rules, says in cascade:
        if rule := rules.match(text, at):
            return says[rule.lastindex - 1]
    return False


def tables(text: str) -> tuple[str, ...]:
    """The tables for a text: its languages by votes, the first ahead of the others, its scripts, the common one."""
    votes = dict.fromkeys(VOTES, 0)
    for w in _LETTERS.findall(text.lower()):
        for k in _VOTERS.get(w, ()):
            votes[k] += 1
    found: list[str] = []
    if not text.isascii() and _ANY_SCRIPT.search(text):
        found = [k for k, p in _SCRIPT.items() if p.search(text)]
        found = [k for k in found if not (k == "zh" and "ja" in found)]
    best = max(votes, key=lambda k: (votes[k], k == "en"))
    names = [best, *(k for k in VOTES if votes[k] and k != best)] if votes[best] else [] if found else [*VOTES]
    return ("labels", *names, *found, "common")


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BLANK_LINE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def plain_end(text: str, at: int) -> bool:
    """A word of three small letters or more, one mark, white space and a capital letter: no rule but the common break fits, unless the word is in _LAST."""
    if text[at - 1] not in ".!?" or not text[at : at + 1].isspace() or not text[at + 1 : at + 2].isupper():
        return False
    word = text[max(0, at - 40) : at - 1].rsplit(None, 1)[-1:]
    return bool(word) and len(word[0]) > 2 and word[0].isalpha() and word[0][-1].islower() and word[0] not in _LAST


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of code points, without white space around them; none for a null or blank text."""
    spans: list[tuple[int, int]] = []
    if not text or text.isspace():
        return spans
    names = tables(text)
    cascade = [_table(n) for n in names]
    candidates = CANDIDATE_THAI if "th" in names else CANDIDATE
    for low, high in _blocks(text):
        block = text[low:high]
        if block.strip() == "":
            continue
        cuts = []
        for m in candidates.finditer(block):
            at = m.end()
            if plain_end(block, at) or breaks(cascade, block, at):
                cuts.append(at)
        begin, own = 0, []
        for cut in (*cuts, len(block)):
            part = block[begin:cut]
            if bare := part.strip():
                start = low + begin + len(part) - len(part.lstrip())
                if own and not _SOLID.search(bare):  # marks alone belong to what stands before them
                    own[-1] = (own[-1][0], start + len(bare))
                else:
                    own.append((start, start + len(bare)))
            begin = cut
        if len(own) > 1 and not _SOLID.search(text[own[0][0] : own[0][1]]):
            own[:2] = [(own[0][0], own[1][1])]
        spans += own
    return spans


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos) of each sentence of each row, as code points from 0, end exclusive.

    White space around a sentence is left out, everything else lies in exactly one. A null or blank text has
    no sentence. A text of one sentence, however long, gives one. Rows with the same key and text give the same
    sentences, once each row; null keys are kept; other columns are ignored. An empty table gives an empty result. No shuffle.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                texts = part.column(1).to_pylist()
                once = {t: sentences(t) for t in {*texts}}
                found = [once[t] for t in texts]
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = np.array([s for f in found for s in f], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[key, "start_pos", "end_pos"])

    return df.select(F.col(key), F.col(text).cast("string").alias("txt")).mapInArrow(run, schema)
