"""Defective answers in prompt-answer pairs: empty, refusal, copy, wrong language, truncated.

Languages are compared by the posteriors of a naive Bayes model over character n-grams, fitted on labelled texts. Refusals are
told by first-person patterns and by a naive Bayes model over words, of refusals against a sample of the answers themselves. Truncation
is a matter of how texts end: over all answers it is counted how often each context of one to four tokens, with the words taken from the
prompt as one token, is followed by the end of a sentence and how often by more.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import Scratch, hashed_share, unique_join

#: Labelled texts that the language model is fitted on, of each language, none longer than this.
PER_LANGUAGE, LONGEST = 300, 20_000
BUCKETS, ALPHA = 1 << 15, 0.05
#: Distinct answers, none longer than SAID_LONGEST, that the refusal model takes for sound ones; log odds, in all and for each known word, that make a refusal.
SAID, SAID_LONGEST, REFUSED, REFUSED_EACH = 4000, 2000, 6.0, 1.0
ORDERS = (1, 2, 3, 4)
#: Log odds for each letter, and in all, by which another language must win.
PER_LETTER, IN_ALL = 0.12, 4.0
#: Sentence ends among a context's followers below which a text that stops there broke off; least support of a context.
ENDS, SUPPORT = 0.2, 3

# General text of each language, none of it from the data: public declarations of rights in the words of their languages, and frequent words. It stands
# beside the labelled texts, whose languages and subjects are few.
GENERAL = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. No one shall be held in slavery. Everyone has the right to recognition everywhere as a person before the law. the of and to in that is was it for with as his on be at by had this not are but from or have an they which one you were all her she there would their we him been has when who no more if out so up what about than into could only other new some time these two may then first any now such like our over most even made after also well many before must through where much should because people same already both between without says nothing while known adds less also here closest similar different aspect meaning content statement",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei gehalten werden. Jeder hat das Recht, überall als rechtsfähig anerkannt zu werden. der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine seiner worden will zwischen immer was sagte gibt alle seit muss doch jetzt drei neue neuer neues neuen damit bereits da ihr seinen müssen ab ihrer ohne sondern selbst ersten nun etwa heute weil ihm liegt dazu bekannt gleich anderer Aspekt Inhalt Bedeutung ähnlich fehlt bleibt hier dieselbe Aussage",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage. Chacun a le droit à la reconnaissance en tous lieux de sa personnalité juridique. de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou mais comme cette été deux fait nous leur elle ses même sans être ont ces autres entre aussi dont tout si après bien encore avant lui moins faire peut où leurs était contre déjà très depuis nouveau nouvelle première quelques lors toujours aucun ainsi alors car trois sous doit celui chez selon non peu chaque rien seul seule aspect contenu sens semblable manque reste ici connu connue puisque cependant phrase affirmation",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud. Todo ser humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica. de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella tres nuevo nueva nuevos dijo pues contra aspecto contenido sentido parecido falta queda aquí conocido conocida misma afirmación ningún nada añade",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Nessun individuo potrà essere tenuto in stato di schiavitù. Ogni individuo ha diritto, in ogni luogo, al riconoscimento della sua personalità giuridica. di e il la che in a per un è del non una le si da con i dei sono al alla come più della ha nel gli lo ma o anche delle su se nella ad dal questo loro stato essere due dalla tra ai degli era suo cui sua quando prima molto così fra dopo tutti ogni solo stesso stessa già poi ancora perché senza altri altro contro quello quella dove fatto anni può sia mentre deve hanno ne ci mi quindi nuovo nuova manca resta qui noto nota nessuno niente aspetto contenuto simile frase affermazione vicino dallo sullo negli",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura. Todos os indivíduos têm direito ao reconhecimento, em todos os lugares, da sua personalidade jurídica. de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós novo nova falta aqui conhecido nenhum nada aspeto conteúdo semelhante afirmação vizinho",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft recht op leven, vrijheid en onschendbaarheid van zijn persoon. Niemand zal in slavernij worden gehouden. Een ieder heeft, waar hij zich ook bevindt, het recht als persoon erkend te worden voor de wet. de van het een en in is dat op te zijn met voor die niet aan er om ook als dan maar bij nog uit door over ze zich naar heeft hij hebben deze wordt tot je meer of kan worden wat wel geen al was ik men dit we zo zou zijn hun moet werd nu daar veel tussen tegen onder zonder andere nieuwe nieuw hier bekend ontbreekt blijft zelfde bewering inhoud betekenis niets buur",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby. i w nie na się z do to że a o jak ale po co tak za od jest przez dla czy tylko są był jego być już może nowy nowa bez więc",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Var och en har rätt till liv, frihet och personlig säkerhet. och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får ny nytt inget saknas",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır. ve bir bu için de da ile çok daha gibi olarak ne kadar sonra var en olan ama yeni değil",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. и в не на что с по как это но из у за от так к для же вы бы мы только уже или если новое",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。この文は新しい内容ではありません。これについて何も述べていないため、別のものです。",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。这个句子没有新的内容，意思相同，因此不是新的。",
    "ar": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق، وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء. لكل فرد الحق في الحياة والحرية وسلامة شخصه.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
}
#: Weight of the general text, as often as it is read.
GENERAL_TIMES = 40
# What stands in for a missing answer, in bare letters and digits.
PLACEHOLDERS = frozenset("na none null nil nan tbd tba todo blank empty noanswer norationale norationalegiven norationaleprovided notavailable notapplicable notgiven notprovided unknown pending missing undefined placeholder nocomment nothing noresponse nodata xxx xx x insertrationalehere rationale keineangabe keine keineantwort leer ka sinrespuesta ninguno ninguna vacío nd aucun aucune néant sansréponse pasderéponse vide nessuno nessunarisposta vuoto".split())
REFUSAL = regex.compile(
    r"""\b(?:as\ an?\ (?:ai|artificial|language)\b
    |(?:i(?:['’]?m|\ am)|we\ are)\ (?:sorry|afraid|unable|not\ (?:able|allowed|permitted|in\ a\ position))\b(?!\ to(?:\ (?:find|see|locate|detect|match|identify|trace|spot)\b|\ ?(?:…|\.\.\.)|\ ?$|\ (?:f|fi|fin|s|se|sp|spo|l|lo|loc|loca|locat|d|de|det|dete|detec|m|ma|mat|matc|i|id|ide|iden|ident|identi|identif|t|tr|tra|trac)$))
    |i\ (?:apologi[sz]e|decline|refuse|abstain)\b|i\ (?:must|have\ to|need\ to|would\ rather|prefer\ to)\ (?:decline|refrain|abstain|refuse|pass)\b
    |it\ is\ not\ possible\ for\ me\b|refrain\ from\ (?:an?y?\ )?(?:assessment|judg|comment)
    |i\ (?:can(?:not|['’]?t|\ not)|won['’]?t|will\ not|could\ not|couldn['’]?t|may\ not|must\ not)\ (?:\w+ly\ )?(?:judge|compare|assist|help|provide|rate|comply|answer|evaluate|assess|decide|continue|discuss|process|respond|do|give|make|offer|fulfil|take|complete|perform|comment)
    |(?:unable|not\ able|not\ possible\ for\ me|impossible\ for\ me)\ to\ (?:comply|assist|help|judge|answer|compare|rate|provide|evaluate|assess)
    |my\ (?:guidelines|instructions|policy|policies|rules|programming)\ (?:do\ not|don['’]?t|does\ not|forbid|prevent|prohibit)
    |(?:leider|bedaure|bedauerlicherweise)\b.{0,40}\b(?:kann|darf|möchte)\ ich\b|(?:kann|darf)\ ich\ .{0,80}\bnicht\b|ich\ (?:kann|darf|werde)\ .{0,60}\bnicht\b|tut\ mir\ leid|als\ ki\b|(?:ich\ muss|muss\ ich)\ .{0,60}\b(?:ablehnen|verzichten|passen)|ich\ bin\ nicht\ (?:in\ der\ lage|befugt)
    |désolée?\b|je\ (?:suis\ désolée?|regrette|m['’]excuse|refuse)\b|je\ ne\ (?:peux|puis|suis|pourrai|saurais)\ pas\b|je\ ne\ (?:peux|puis|saurais)\b|je\ dois\ (?:décliner|refuser|m['’]abstenir)|en\ tant\ qu['’](?:ia|assistant|intelligence|modèle)
    |lo\ (?:siento|lamento)\b|lamentablemente\b|no\ (?:puedo|me\ es\ posible|estoy\ en\ condiciones)\b|como\ (?:ia|asistente|modelo)\b|debo\ (?:rechazar|declinar|abstenerme)
    |mi\ dispiace\b|non\ posso\b|sono\ spiacente|come\ (?:ia|assistente|modello)\b)""",
    regex.IGNORECASE | regex.VERBOSE,
)
_QUOTED = regex.compile(r"«[^«»]*»|„[^„“”]*[“”]|“[^“”]*”|\"[^\"]*\"|‘[^‘’]*’(?!\w)|‹[^‹›]*›")
_REFUSAL_HINT = re.compile(r"\b(?:i|we|me|my|ai|ich|ki|mir|je|ia|désolée?|lo|no|debo|lamentablemente|como|mi|non|sono|come|unable|able|impossible|refrain|leider|bedaure|bedauerlicherweise|en tant)\b", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?;。]\s+")
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")
_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"[^\W\d_]+")
_SCAFFOLD = frozenset("classify compare evaluate judge assess the this following task question label decide id quality qualities neighbor neighbors neighbour neighbours sentence score decision rationale novel spans prompt item candidate input text rank".split())
_STOP = frozenset(".!?。！？।؟")
_CLOSERS = frozenset("\"'”’»“)]}")
_OPENERS = (("«", "»"), ("„", "“"), ("(", ")"), ("[", "]"))


def plain(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


class Sources:
    """What an answer may take from its prompt: the quality and the neighbours' sentences."""

    def __init__(self, quality: str | None, sentences: list[str]):
        self.words = [words(t) for t in (quality, *sentences) if t]
        self.pairs = {p for w in self.words for p in zip(w, w[1:])}


# --- languages -------------------------------------------------------------------------------


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the blocks and 1- to 3-grams of the letters of all texts, the text of each, and each text's letters."""
    kept = [_RUN.findall(t.lower()) for t in texts]
    letters = np.array([sum(map(len, k)) for k in kept], np.int64)
    padded = [f" {' '.join(k)} " for k in kept]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    grams, rows = [], []
    for n in (0, 1, 2, 3):  # 0: the block of 128 characters, which tells scripts apart
        if len(c) < n:
            break
        h = (c >> np.uint64(7)) + np.uint64(1 << 40) if n == 0 else c[: len(c) - n + 1].copy()
        for k in range(1, n):
            h = h * np.uint64(1_000_003) + c[k : len(c) - n + 1 + k]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        own = row[: len(h)] == row[max(0, n - 1) :]
        grams.append(h[own].astype(np.int64))
        rows.append(row[: len(h)][own])
    return (np.concatenate(grams), np.concatenate(rows), letters) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64), letters)


@dataclass
class Languages:
    """Naive Bayes: log P(n-gram bucket | language)."""

    names: list[str]
    logp: np.ndarray

    @staticmethod
    def fit(texts: list[tuple[str, str]]) -> Languages:
        names = sorted({lang for lang, _ in texts})
        counts = np.zeros((len(names), BUCKETS))
        for lang, text in texts:
            counts[names.index(lang)] += np.bincount(_grams([text])[0], minlength=BUCKETS)
        p = counts / counts.sum(1, keepdims=True)
        logp = np.log(p + ALPHA / BUCKETS) - np.log(1 + ALPHA)
        return Languages(names, np.ascontiguousarray(logp.T, np.float32))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods by text and language (the n-grams of a letter share one weight), and the letters of each text."""
        grams, rows, letters = _grams(texts)
        order = np.argsort(rows, kind="stable")
        out = np.zeros((len(texts), len(self.names)))
        if len(grams):
            at = rows[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out[at[first]] = np.add.reduceat(self.logp[grams[order]], first, axis=0, dtype=np.float64) / 4
        return out, letters


def fit_languages(documents: DataFrame, text: str, lang: str) -> Languages:
    """Fit on at most PER_LANGUAGE labelled texts of each language, chosen by hash.

    Labels are taken by their first part in lower case (`de-AT` and `DE` are `de`); rows with a null or
    blank text or label, or with a text longer than LONGEST, give nothing. GENERAL is added, so that
    languages without a label are known too; no row at all is fine.
    """
    rows = documents.select(F.lower(F.regexp_extract(F.trim(F.col(lang)), "^[A-Za-z]{2,3}", 0)).alias("l"), F.col(text).alias("t")).filter("l <> ''").filter(F.length("t").between(20, LONGEST))
    rows = rows.withColumn("h", F.xxhash64("t")).selectExpr("*", "row_number() over (partition by l order by h) as nth").filter(f"nth <= {PER_LANGUAGE}")
    return Languages.fit([(r.l, r.t) for r in rows.select("l", "t").collect()] + [(k, v) for k, v in GENERAL.items() for _ in range(GENERAL_TIMES)])


# --- refusals ---------------------------------------------------------------------------------

# Ways to decline, written for this model; they stand against a sample of the answers.
REFUSALS = """
I would rather not give an opinion on this one. | This is not something I can weigh in on. | Judging this is beyond my remit. | I am going to pass on this question. | Sorry, this request is outside of what I can help with.
I have been told not to comment on such matters. | It would be inappropriate for me to assess that. | I don't feel comfortable making this call. | No verdict from me, this touches on legal advice. | I'll have to leave this unanswered.
My apologies, but I am unwilling to answer. | I choose not to respond to this prompt. | Please consult a professional, I can give no advice on it. | Answering would violate my policy. | I'm not permitted to offer a judgement. | Regrettably I can be of no help here.
I lack the authority to decide this, ask somebody else. | This falls outside my competence, so I abstain. | We must turn down this request. | I was not designed to evaluate this kind of content. | As a language model I do not hold opinions. | I shall not take a position.
That is a matter I prefer to stay out of. | Unable to comply with this instruction. | I can not fulfil this task, thank you for your understanding.
A judgement on this is not available. | No verdict will be given here. | It is declined to rate such content. | The question has to stay unanswered for policy reasons. | This prompt may not be processed under the usage policy. | An opinion can not be offered in this case, contact legal counsel. | Requests of this type are refused. | For questions of law please turn to an attorney.
No answer can be provided because of safety policies. | This task was rejected, it breaks the terms of use. | The system is not allowed to evaluate this input. | Evaluation of such items is not supported. | Help with that can not be given. | Assessing this would be against the rules.
Eine Bewertung ist hier nicht möglich, bitte fragen Sie einen Juristen. | Die Anfrage wird abgelehnt. | Hierzu kann keine Auskunft erteilt werden. | Diese Aufgabe darf nach den Nutzungsregeln nicht bearbeitet werden. | Eine Einschätzung wird nicht abgegeben. | Rechtliche Fragen werden hier nicht beantwortet.
Aucun avis ne peut être donné ici, adressez-vous à un avocat. | La demande est rejetée. | Cette requête ne peut pas être traitée selon les règles d’utilisation. | Une évaluation n’est pas possible. | Il n’est pas permis de répondre à cette question.
No se puede dar una opinión aquí, consulte a un abogado. | La solicitud se rechaza. | Esta petición no puede tramitarse según las normas de uso. | No es posible ofrecer una valoración. | No está permitido responder a esta pregunta.
Dazu möchte ich mich nicht äußern. | Das zu beurteilen steht mir nicht zu. | Bei dieser Anfrage muss ich passen. | Hierzu gebe ich kein Urteil ab. | Ich enthalte mich einer Bewertung. | Diese Frage liegt außerhalb meiner Zuständigkeit. | Bitte wenden Sie sich an eine Fachperson, ich darf nicht beraten.
Entschuldigung, dabei helfe ich nicht. | Meine Richtlinien verbieten mir eine Antwort. | Das lehne ich ab. | Als Sprachmodell habe ich keine Meinung. | Es ist mir nicht gestattet, eine Einschätzung zu geben. | Ich sehe mich außerstande, diese Aufgabe zu erfüllen. | Eine Entscheidung treffe ich hier nicht. | Dafür bin ich nicht der richtige Ansprechpartner.
Je préfère ne pas me prononcer sur ce point. | Il ne m’appartient pas de juger cela. | Désolé, cette demande dépasse mes compétences. | Je m’abstiens de tout avis. | Je n’ai pas le droit de donner une évaluation. | Mes règles m’interdisent de répondre. | Veuillez consulter un spécialiste, je ne donne pas de conseil.
En tant que modèle de langage, je n’ai pas d’opinion. | Je suis dans l’impossibilité de traiter cette requête. | Je refuse de trancher. | Ce n’est pas à moi d’en décider. | Je passe mon tour sur cette question. | Toutes mes excuses, je ne fournirai pas de réponse. | Il serait déplacé que je commente.
Prefiero no opinar sobre este punto. | No me corresponde juzgar esto. | Disculpe, esta solicitud queda fuera de mis competencias. | Me abstengo de dar una valoración. | No tengo permiso para evaluar esta frase. | Mis normas me prohíben responder. | Consulte a un especialista, no doy asesoramiento.
Como modelo de lenguaje no tengo opinión. | Rechazo esta petición. | Esta vez paso, no voy a decidir. | No estoy autorizado a comentar este asunto. | Perdone, no le ayudaré con eso. | Sería inapropiado que yo lo valorase. | No quiero pronunciarme.
Preferisco non esprimermi su questo. | Non spetta a me giudicare. | Mi astengo da una valutazione. | Le mie regole mi vietano di rispondere. | Mi scuso, questa richiesta va oltre le mie competenze. | Rifiuto di decidere.
Prefiro não opinar sobre isto. | Não me cabe julgar. | Peço desculpa, não posso avaliar. | As minhas regras proíbem-me de responder. | Daar wil ik mij niet over uitspreken. | Het is niet aan mij om dat te beoordelen. | Sorry, hier kan ik niet mee helpen. | Mijn regels verbieden mij te antwoorden.
"""


def _features(text: str) -> set[str]:
    """Words and pairs of words outside quotations."""
    w = words(_QUOTED.sub(" ", text))
    return {*w, *(" ".join(p) for p in zip(w, w[1:]))}


@dataclass
class Refusals:
    """Naive Bayes: log odds of each feature met in a refusal or a sound answer; others tell nothing."""

    odds: dict[str, float]

    @staticmethod
    def fit(sound: list[str]) -> Refusals:
        told = [t.strip() for line in REFUSALS.strip().splitlines() for t in line.split("|")]
        told = [p for t in told for p in _SENTENCE_END.split(t)]
        sound = [p for t in sound if not REFUSAL.search(_QUOTED.sub(" ", t)) for p in _SENTENCE_END.split(_QUOTED.sub(" ", t))]
        yes, no = (Counter(f for t in texts for f in _features(t)) for texts in (told, sound))
        n, m = len(told), max(1, len(sound))
        no = Counter({f: c - 1 for f, c in no.items() if c > 1})  # one answer alone is no evidence: it may be the one that is judged
        for f in {f for t in GENERAL.values() for f in words(t)}:  # frequent words of a language that the answers lack are no sign of a refusal
            no[f] += max(1, m // 20)
        return Refusals({f: float(np.log((yes[f] + 0.1) / (n + 0.2)) - np.log((no[f] + 0.1) / (m + 0.2))) for f in {*yes, *no}})

    def declines(self, text: str) -> bool:
        """Whether any sentence of the text reads like a refusal."""
        for part in _SENTENCE_END.split(_QUOTED.sub(" ", text)):
            known = [self.odds[f] for f in _features(part) if f in self.odds]
            if sum(known) > max(REFUSED, REFUSED_EACH * len(known)):
                return True
        return False


def fit_refusals(answers: DataFrame, text: str) -> Refusals:
    """Fit on REFUSALS against about SAID distinct answers, chosen by hash; null, blank and longer ones give nothing."""
    rows = answers.select(F.col(text).cast("string").alias("t")).filter(F.length(F.trim("t")).between(1, SAID_LONGEST))
    n = rows.select(F.xxhash64("t").alias("h")).distinct().count()
    return Refusals.fit(sorted(r.t for r in rows.filter(hashed_share(F.col("t"), SAID, n)).distinct().collect()))


# --- how texts end ---------------------------------------------------------------------------


def skeleton(text: str, sources: Sources) -> tuple[list[str], list[list[str]]]:
    """Tokens with every run of two or more words of a source as `<Q>` and numbers as 9, and the words of each run."""
    known = sources.pairs
    toks = _TOKEN.findall(plain(text).replace("...", " … "))
    out: list[str] = []
    runs: list[list[str]] = []
    i = 0
    while i < len(toks):
        j = i
        while j + 1 < len(toks) and (toks[j], toks[j + 1]) in known:
            j += 1
        if j > i:
            out.append("<Q>")
            runs.append(toks[i : j + 1])
        else:
            out.append("9" if toks[i].isdigit() else toks[i])
            runs.append([])
        i = j + 1
    return out, runs


def _hash(*parts: str) -> int:
    """64 bits, signed."""
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


_START = np.uint64(0x9E3779B97F4A7C15)


class Tokens(dict):
    """64 bits of each token."""

    def __missing__(self, token: str) -> int:
        out = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return out


_TOKENS = Tokens()


def context_keys(toks: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys by order and place, whether there is such a context, first place of each text) of the contexts that end with each token.

    A place is that of a token; before the first one stands a mark, which a context may begin with but not reach beyond.
    """
    if len(_TOKENS) > 500_000:
        _TOKENS.clear()
    size = np.array([len(t) for t in toks], np.int64)
    first = np.cumsum(size) - size
    own = np.fromiter((_TOKENS[t] for x in toks for t in x), np.uint64, int(size.sum()))
    place = np.arange(len(own)) - np.repeat(first, size)
    keys, there = np.zeros((len(ORDERS), len(own)), np.uint64), np.zeros((len(ORDERS), len(own)), bool)
    key = np.zeros(len(own), np.uint64)
    for k in ORDERS:
        back = place - (k - 1)  # the token that the context begins with, -1 being the mark
        token = np.where(back >= 0, own[np.maximum(np.arange(len(own)) - (k - 1), 0)], _START)
        key = (key ^ token) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        keys[k - 1], there[k - 1] = key + np.uint64(k), back >= -1
    return keys.view(np.int64), there, first


def _run_cell(word: str) -> int:
    return _hash("r", word)


def _ends(toks: list[str]) -> list[bool]:
    """For each token whether nothing but closing marks stands between it and the end of a sentence."""
    out, over = [], True
    for t in reversed(toks):
        out.append(over)
        over = t in _STOP or (over and t in _CLOSERS)
    return out[::-1]


def copy_keys(toks: list[str], runs: list[list[str]]) -> list[int]:
    """Of a text without a full stop, what its copies share: the hash of its skeleton, and that with the last word if it ends in a run."""
    n = len(toks)
    while n and toks[n - 1] in _CLOSERS:
        n -= 1
    if not n or toks[n - 1] in _STOP:
        return []
    return [_hash("c", *toks[:n]), *([_hash("l", runs[n - 1][-1], *toks[:n])] if runs[n - 1] else [])]


def count_ends(skeletons: list[tuple[list[str], list[list[str]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, ended, more): followers of each context and of the last words of prompt runs that end a sentence, and that don't; copy keys count as ended."""
    shapes: Counter[tuple[str, ...]] = Counter()
    single: Counter[int] = Counter()
    inner: Counter[str] = Counter()
    for toks, runs in skeletons:
        shapes[tuple(toks)] += 1
        single.update(copy_keys(toks, runs))
        for run in runs:
            if run:
                single[_run_cell(run[-1])] += 1
                inner.update(run[:-1])
    toks = [[*t] for t in shapes]
    keys, there, _ = context_keys(toks)
    weight = np.repeat(np.fromiter(shapes.values(), np.int64, len(shapes)), [len(t) for t in toks])
    ends = np.fromiter((e for t in toks for e in _ends(t)), bool, len(weight))
    cells = [keys[there], np.fromiter(single, np.int64, len(single)), np.fromiter((_run_cell(w) for w in inner), np.int64, len(inner))]
    twice = np.broadcast_to(weight, there.shape)[there], np.broadcast_to(ends, there.shape)[there]
    ended = [np.where(twice[1], twice[0], 0), np.fromiter(single.values(), np.int64, len(single)), np.zeros(len(inner), np.int64)]
    more = [np.where(twice[1], 0, twice[0]), np.zeros(len(single), np.int64), np.fromiter(inner.values(), np.int64, len(inner))]
    cell, at = np.unique(np.concatenate(cells), return_inverse=True)
    return cell, *(np.bincount(at, np.concatenate(x), len(cell)).astype(np.int64) for x in (ended, more))


@dataclass
class Evidence:
    """What tells of a text whose form does not tell how it ends: the cells of its contexts, the longest first, of its last run, of
    its own copies, and whether its last word begins a longer one of the prompt."""

    contexts: list[int]
    run: int | None
    skeleton: int
    run_skeleton: int | None
    begins: bool


def breaks_off(text: str, sources: Sources, told: tuple[list[str], list[list[str]]]) -> bool | Evidence:
    """Whether the text stops before its end, or the evidence if its form does not tell; told is its skeleton."""
    bare = text.strip()
    if re.search(r"(?:…|\.\.\.)[\"'”’»)\]]*$", bare):
        return True
    closed = re.sub(r"[\s\"'”’»“)\]}]+$", "", bare)
    if closed and closed[-1] in _STOP:
        return False
    if bare[-1:] in ",;:-–—(„«“‘/&+" and bare[-1:] not in "“":
        return True
    if any(bare.count(a) > bare.count(b) for a, b in _OPENERS) or bare.count('"') % 2:
        return True
    toks, runs = ([*x] for x in told)
    n = len(toks)
    while toks and toks[-1] in _CLOSERS:
        toks.pop()
        runs.pop()
    if not toks:
        return False
    run, begins = None, False
    if runs[-1] and len(toks) == n:
        run = _run_cell(runs[-1][-1])
    elif not runs[-1] and toks[-1].isalpha():
        # The last word as the beginning of a longer one of the prompt.
        w = toks[-1]
        source = {x for s in sources.words for x in s}
        begins = w not in source and any(x.startswith(w) for x in source)
    keys, there, _ = context_keys([toks])
    own = copy_keys(toks, runs)
    return Evidence(keys[:, -1][there[:, -1]][::-1].tolist(), run, own[0] if own else 0, own[1] if len(own) > 1 else None, begins)


def broke_off(contexts: str, run: str, copies: str, run_copies: str, begins: str) -> str:
    """Whether a text stops before its end, by its evidence, as a SQL condition.

    contexts is an array of (ended, more), the longest context first, run the same of its last word of the prompt, each with all its copies.
    Where other texts go on after its longest context, none of its copies is evidence that it is whole. Where none does, as with a
    short note that is always written without a full stop, only the text itself is left out. The first context that enough
    other texts have decides; a text that ends as no other does broke off.
    """
    own = f"if({contexts}[0].more = 0, 1, {copies})"
    ended = f"greatest({run}.ended - {run_copies}, 0)"
    by_run = f"({ended} + {run}.more >= {SUPPORT} and {ended} < {ENDS} * ({ended} + {run}.more))"
    told = f"filter(transform({contexts}, c -> struct(greatest(c.ended - {own}, 0) as ended, c.more as more)), c -> c.ended + c.more >= {SUPPORT})"
    by_context = f"coalesce(get(transform({told}, c -> c.ended < {ENDS} * (c.ended + c.more)), 0), true)"
    by_begin = f"({begins} and {contexts}[size({contexts}) - 1].more <= {contexts}[size({contexts}) - 1].ended)"
    return f"({by_begin} or coalesce({by_run}, false) or {by_context})"


def span_breaks_off(span: str, quality: str) -> bool:
    """Whether a span taken from the quality stops within a word, or ends with an ellipsis."""
    if re.search(r"(?:…|\.\.\.)\s*$", span):
        return True
    flat = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip()
    s, q = flat(span), flat(quality)
    if not s or not s[-1].isalnum():
        return False
    at, cut, whole = q.find(s), False, False
    while at >= 0:
        end = at + len(s)
        inside = end < len(q) and regex.match(r"[\p{L}\p{M}\p{N}]", q[end]) is not None
        cut, whole = cut or inside, whole or not inside
        at = q.find(s, at + 1)
    return cut and not whole


# --- one pair --------------------------------------------------------------------------------


def is_empty(text: str | None) -> bool:
    bare = "".join(words(text or ""))
    return not bare or bare in PLACEHOLDERS


def is_copy(text: str, sources: Sources) -> bool:
    """Nothing but the quality, neighbour sentences or the prompt item: apart from field names and numbers, all words stand in runs of a source."""
    w = words(text)
    if not w:
        return False
    if sum(p in sources.pairs for p in zip(w, w[1:])) < min(2, len(w) - 1):
        return False
    known = [" " + " ".join(s) + " " for s in sources.words]
    whole = " " + " ".join(w) + " "
    for k in sorted(known, key=len, reverse=True):
        if len(k.split()) >= 3:
            while k in whole:
                whole = whole.replace(k, " \x00 ", 1)
    if "\x00" not in whole:
        long = [k for k in known if len(w) >= 4 and len(w) >= 0.8 * len(k.split()) and " " + " ".join(w) + " " in k]
        return bool(long)
    return all(x == "\x00" or x in _SCAFFOLD or x.isdigit() for x in whole.split())


def own_words(text: str, sources: Sources) -> str:
    """The answer without quoted phrases and words of the prompt."""
    toks = words(_QUOTED.sub(" ", text))
    drop = {j for i in range(len(toks) - 1) if (toks[i], toks[i + 1]) in sources.pairs for j in (i, i + 1)}
    return " ".join(t for i, t in enumerate(toks) if i not in drop)


def other_language(answers: list[str], qualities: list[str], model: Languages) -> np.ndarray:
    """Whether each answer's own words are in another language than its quality."""
    said, letters = model.scores(answers)
    asked, n = model.scores(qualities)
    home = asked.argmax(1)
    gain = said.max(1) - said[np.arange(len(said)), home] if len(said) else np.zeros(0)
    return (letters >= 5) & (n >= 5) & (gain > np.maximum(IN_ALL, PER_LETTER * letters))


Pair = tuple[str | None, list[str], str | None, list[str | None] | None]


def defects(rows: list[Pair], languages: Languages, refusals: Refusals) -> tuple[list[str | Evidence | None], list[tuple[list[str], list[list[str]]]]]:
    """The defect of each (quality, neighbour sentences, rationale, spans), or None, or the evidence that tells whether it is truncated; and the
    skeletons of the answers that are not empty."""
    out: list[str | Evidence | None] = [None] * len(rows)
    open_: list[tuple[int, Sources, tuple]] = []
    skeletons = []
    for i, (quality, sentences, rationale, _) in enumerate(rows):
        if is_empty(rationale):
            out[i] = "empty"
            continue
        sources = Sources(quality, sentences)
        told = skeleton(rationale, sources)
        skeletons.append(told)
        if is_copy(rationale, sources):
            out[i] = "copy"
        elif (_REFUSAL_HINT.search(rationale) and REFUSAL.search(_QUOTED.sub(" ", rationale))) or refusals.declines(rationale):
            out[i] = "refusal"
        else:
            open_.append((i, sources, told))
    foreign = other_language([own_words(rows[i][2], s) for i, s, _ in open_], [rows[i][0] or "" for i, _, _ in open_], languages)
    for (i, sources, told), f in zip(open_, foreign):
        quality, _, rationale, spans = rows[i]
        named = [s for s in spans or [] if s and s.strip()]
        if f:
            out[i] = "wrong_language"
        elif named and quality and span_breaks_off(named[-1], quality):
            out[i] = "truncated"
        elif broken := breaks_off(rationale, sources, told):
            out[i] = broken if isinstance(broken, Evidence) else "truncated"
    return out, skeletons


def _rows(b: pa.RecordBatch) -> Iterator[Pair]:
    for q, n, r, s in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
        yield q, [x for x in n or [] if x], r, s


def find_defects(df: DataFrame, languages: Languages, refusals: Refusals, key: str = "result_id", quality: str = "quality", neighbors: str = "neighbors", rationale: str = "rationale", spans: str = "novel_spans", when: str | None = None) -> DataFrame:
    """(key, defect) of every answer that is empty, copy, refusal, wrong_language or truncated, the first that fits.

    Rows delivered again under the same key count once, the last by the column when, else the greatest; a null key is a row like any other of its key. A null or
    blank rationale is empty; a null quality has no language to compare; null neighbours, sentences, spans
    and empty lists are fine. The end-of-text counts are taken over all answers and joined to those whose form does not tell
    how they end, equal askings once; nothing of them reaches the driver. An empty table gives an empty result.
    """
    said = F.struct(F.col(when) if when else F.lit(0).alias("at"), F.col(rationale).cast("string").alias("rationale"), F.col(quality).cast("string").alias("quality"), F.transform(F.coalesce(F.col(neighbors), F.expr("array()")), lambda n: n["sentence"]).alias("neighbors"), F.col(spans).cast("array<string>").alias("spans"))
    rows = df.select(F.col(key).alias("key"), said.alias("r")).groupBy("key").agg(F.max("r").alias("r")).select("key", "r.quality", "r.neighbors", "r.rationale", "r.spans")
    long, kind = T.LongType(), df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("defect", T.StringType()), T.StructField("ask", T.ArrayType(long)), T.StructField("begins", T.BooleanType()), T.StructField("cell", long), T.StructField("ended", long), T.StructField("more", long)])
    plain = pa.schema([("defect", pa.string()), ("ask", pa.list_(pa.int64())), ("begins", pa.bool_()), ("cell", pa.int64()), ("ended", pa.int64()), ("more", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [*_rows(b)]
            found, skeletons = [], []
            for at in range(0, len(rows), 1000):
                f, told = defects(rows[at : at + 1000], languages, refusals)
                found += f
                skeletons += told
            hit = pa.array(np.flatnonzero([f is not None for f in found]), pa.int64())
            found = [f for f in found if f]
            open_ = [f if isinstance(f, Evidence) else None for f in found]
            # What is asked: the last run, the copies and those with the same run, then the contexts; 0 for none.
            ask = [e and [e.run or 0, e.skeleton, e.run_skeleton or 0, *e.contexts] for e in open_]
            none = [pa.nulls(len(found), t) for t in [pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([b.column(0).take(hit), pa.array([None if e else f for f, e in zip(found, open_)], pa.string()), pa.array(ask, pa.list_(pa.int64())), pa.array([e and e.begins for e in open_], pa.bool_()), *none], names=schema.names)
            if skeletons:
                counts = [pa.array(x) for x in count_ends(skeletons)]
                n = len(counts[0])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, b.schema.types[0]), *(pa.nulls(n, t) for t in plain.types[:3]), *counts], names=schema.names)

    s = Scratch(df.sparkSession)
    every = s.write(rows.mapInArrow(run, schema))
    decided = every.filter("defect is not null").select("key", "defect")
    open_ = every.filter("ask is not null").select("key", "ask", "begins")
    asked = s.write(open_.groupBy("ask", "begins").agg(F.count("*").alias("n")))
    cells = s.write(asked.select("ask", "begins", F.posexplode("ask").alias("at", "cell")).filter("cell <> 0"))
    counts = every.filter("cell is not null").groupBy("cell").agg(F.sum("ended").alias("ended"), F.sum("more").alias("more"))
    got = unique_join(cells, counts, "cell", "left").groupBy("ask", "begins").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("ended", F.lit(0)).alias("ended"), F.coalesce("more", F.lit(0)).alias("more")))).alias("c"))
    one = lambda i: f"get(filter(c, x -> x.at = {i}), 0)"
    got = got.select("ask", "begins", F.expr("filter(c, x -> x.at > 2)").alias("contexts"), F.expr(one(0)).alias("run"), F.expr(f"coalesce({one(1)}.ended, 1)").alias("copies"), F.expr(f"coalesce({one(2)}.ended, 1)").alias("run_copies"))
    cut = got.filter(broke_off("contexts", "run", "copies", "run_copies", "begins")).select(F.struct("ask", "begins").alias("told"))
    hot = [r[0] for r in asked.filter(F.col("n") > max(1000, (asked.agg(F.sum("n")).first()[0] or 0) // 128)).select(F.struct("ask", "begins").alias("told")).collect()]
    told = open_.select("key", F.struct("ask", "begins").alias("told"))
    if hot:  # askings that hold a large share of the rows, fewer than 128
        few = df.sparkSession.createDataFrame([(h,) for h in hot], told.select("told").schema)
        broad = F.broadcast(few.join(cut, "told", "left_semi"))
        cut = cut.join(F.broadcast(few), "told", "left_anti")
        some = told.join(broad, "told", "left_semi").unionByName(told.join(F.broadcast(few), "told", "left_anti").join(cut, "told", "left_semi"))
    else:
        some = told.join(cut, "told", "left_semi")
    out = decided.unionByName(some.select("key", F.lit("truncated").alias("defect")))
    return out.select(F.col("key").alias(key), "defect")
