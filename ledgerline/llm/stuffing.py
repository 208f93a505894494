"""Keyword-stuffed and link-list pages, by the perplexity of word-class sequences under a prose model.

A text is cut into segments: lines, and sentences within lines. Each token becomes a class: closed-class words
by their kind (articles, prepositions, pronouns ... of many languages), other words by their casing, links,
tags, numbers, codes, and punctuation by itself. An interpolated trigram model over these classes is trained on
the segments of all documents that look like prose; a segment whose perplexity per token is abnormally high
(lists, tags, links) or abnormally low (one phrase over and over) is no prose. Machine text (logs, tables,
settings, code) is told apart by the shape of its lines, except for what stands in such a shape and is a list of
words that come again and again. A page is a case if more than half of its characters stand in abnormal segments
that are no machine text.

Chinese, Japanese and Korean are cut into function words and the pieces between them. Sentences of languages other
than those that shape the model (English, German, French, Spanish), and all texts in scripts without listed function
words, are judged by repetition alone: word order is no evidence there.

The alphabet is closed, so the model has at most ALPHABET**3 entries however large the corpus is; counts are
combined inside the scan and then by a hash aggregation. Texts are read whole, once; all tokens of an Arrow batch
are classified together, and later passes read the class sequences, a byte a token.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

# Closed-class words by kind, English, German, French, Spanish.
CLOSED = {
    "article": "a an the der die das den dem des ein eine einen einem einer eines kein keine keinen einige mehrere le la les un une du el los las una unos unas lo al del l",
    "preposition": "of to in on at by for from with without about after before between into over under until during since through against per near as than von zu mit bei nach vor aus auf für ohne um über unter zwischen durch gegen seit bis im am zum zur ins vom an de à dans sur avec sans pour par entre vers chez après avant depuis pendant au aux en con sin por para sobre entre hasta desde hacia tras según antes después",
    "conjunction": "and or but if because while when then that so although whether unless nor und oder aber wenn bevor nachdem sobald solange weil dass ob denn sondern als während damit obwohl et ou mais si parce que quand lorsque donc car puis y o pero porque cuando aunque mientras ni e u",
    "pronoun": "i you he she it we they me him her us them my your his its our their this these those there who which what whoever whatever someone somebody nobody anyone nothing everything one each every any all some both ich du er sie es wir ihr mich mir dich dir ihn ihm uns euch ihnen sich mein dein sein unser unsere unserem unseren unserer meine meinem deine seine seinem seinen seiner ihre ihrem ihren ihrer dieser diese dieses diesem diesen dies wer was man niemand jemand alles nichts jeder je tu il elle nous vous ils elles me te se lui leur mon ma mes ton ta tes son sa ses notre votre nos autre autres ce cet cette ces ça cela qui personne rien tout tous chaque on yo tú él ella nosotros ustedes ellos ellas le les nos su sus mi mis nuestro nuestra nuestros nuestras otro otra otros otras este esta estos estas ese esa eso quien nadie alguien nada todo cada",
    "verb": "is are was were be been being am has have had do does did can could will would shall should may might must ist sind war waren sein bin bist hat haben hatte hatten wird werden wurde wurden kann können konnte soll sollte muss müssen est sont était étaient être suis ai as a ont avait avaient avons avoir peut peuvent doit fait fut es son era eran fue fueron ser está están estaba ha han había habían hay puede pueden debe",
    "negation": "not no never n't don't doesn't didn't isn't wasn't can't couldn't won't wouldn't shouldn't hadn't haven't hasn't nicht nie niemals nein ne pas jamais non plus no nunca jamás",
    "adverb": "also only just very too again still yet already even how why where here now once auch nur noch schon danach dann davor daher besser sehr wieder hier jetzt da dort wie warum wo aussi encore déjà mieux très ici comme où comment pourquoi también solo ya muy aquí cómo dónde más menos",
}
# The same of further languages; left out is what is an ordinary word in another one.
CLOSED_ELSEWHERE = {
    "article": "il gli i uno della dello degli delle dei nella nello nei nelle alla agli alle dal dalla o os um uma uns umas het een ett egy az ten ta to те та то ο η οι τα του της των τον την ال",
    "preposition": "di su tra fra em no na nos nas ao aos à às pelo pela até desde före efter num numa naar voor uit bij tegen till från hos mellan genom til ved mellom gennem w z ze na do od dla przez przy po nad pod u k v za pre za při için ile gibi kadar göre в во на с со к ко о об от до по за из у при для без через под над про між від із до για από με σε στο στη στην στον στα προς χωρίς من في على إلى عن مع بين حتى منذ של על עם אל מן ב में से को पर का की के तक लिए 在 从 從 对 對 把 被 给 給 向 到 于 於 以 为 為 由 将 將",
    "conjunction": "ed anche ma però quindi pois porém så perché che quando se mentre e ou mas porque então enquanto maar omdat toen dus och eller eftersom att og eller fordi i oraz ale lecz albo czy więc że żeby gdy jeśli bo a nebo protože když ve veya ama fakat çünkü eğer и или а но что чтобы если когда потому пока как хотя та або але що щоб якщо коли και ή αλλά ότι όταν αν γιατί ώστε و أو لكن أن إن إذا لأن ثم ו או אבל כי אם כאשר और या लेकिन कि अगर क्योंकि जब 和 与 與 及 或 但 而 而且 如果 因为 因為 所以 虽然 雖然 还 還 就 则 則 并 並",
    "pronoun": "io lui lei noi voi loro mi ti ci questo questa questi queste quello quella suo sua eu ele ela nós eles elas seu sua meu minha isto isso este esta ik jij hij zij wij jullie hem haar hun ons deze dit dat wie wat jag du han hon vi ni de den det dem denna jeg hun vi dere dem denne dette ja ty on ona my wy oni ich jego jej go mnie się tego tym co kto já ty my vy ten tato co ben sen biz siz onlar bu şu o bir я ты он она оно мы вы они меня мне его ему её ей нас нам вас вам их им это этот эта эти этого тот того кто себя свой все всё який він вона ми ви вони це цей εγώ εσύ αυτός αυτή αυτό εμείς εσείς μου σου μας σας τους αυτά هو هي هم نحن أنا أنت هذا هذه ذلك التي الذي אני אתה הוא היא אנחנו הם זה זאת मैं तुम वह यह हम वे आप उस इस 我 你 您 他 她 它 我们 我們 你们 你們 他们 他們 这 這 那 这个 這個 那个 那個 哪 谁 誰 什么 什麼 自己 每 各 此 其",
    "verb": "estava tivemos temos houve fazer fick tror è sono era erano essere ho hai ha abbiamo hanno avere può possono deve viene são está estão foi era ser tem têm pode podem deve het zijn was waren wordt worden heeft hebben kan kunnen moet är var vara har hade kan ska blir er være kan skal jest są był była było być ma mają może je jsou byl být má olan oldu var yok etti edildi был была было были быть есть будет может можно нужно є був була було бути είναι ήταν έχει έχουν θα μπορεί كان كانت يكون هناك היה היתה יש है हैं था थे थी हो गया किया 是 有 会 會 能 可以 要 应该 應該 可能 必须 必須 做 让 讓 使 没有 沒有",
    "negation": "não nem niet geen inte ikke nie ne není değil не нет ни δεν μην لا لم لن ليس לא नहीं 不 没 沒 未 无 無",
    "adverb": "depois isso outra varför något annat ingen più molto ancora già sempre poi così dove come qui muito ainda já também mais onde assim nog al ook zeer hier daar dan toen heel mycket också redan nu där meget også nå her już jeszcze też tylko bardzo tak jak gdzie teraz ještě jen velmi tak jak çok daha da de sonra önce şimdi очень ещё еще уже только тоже также там здесь тут так где потом теперь более дуже вже ще тільки також πολύ ακόμα επίσης μόνο εδώ εκεί πώς πού جدا أيضا فقط كيف أين גם רק מאוד כאן שם भी ही बहुत अब यहाँ 很 也 都 只 已 已经 已經 再 又 最 更 非常 太 的 了 着 著 过 過 地 得 吗 嗎 呢 吧 啊 们 們 个 個 之 所",
}
# Endings that stand as words of their own behind Korean stems.
KOREAN_ENDINGS = "은 는 이 가 을 를 의 에 에서 에게 로 으로 와 과 도 만 까지 부터 다 요 고 며 지만 면 서 니다 습니다 었다 았다 했다 한다 된다 이다"
_KINDS = list(CLOSED)
_PUNCT = ".,;:!?'\"()[]|/-»·>*#&+=@$%<{}~\\_"
#: Class numbers: 0 ends a segment, then the closed kinds, open classes and punctuation marks.
#: Open words are told apart by how many of them came since the last closed-class word, up to RUN, and by "again":
#: a word that stood before in its segment (in a segment without closed-class words: among the last words of the text).
RUN, RECENT = 6, 12
CLASSES = ["</s>", *_KINDS, *(f"open{i}" for i in range(1, RUN + 1)), "title", "again", "code", "number", "link", "tag", "other", *_PUNCT]
ALPHABET = len(CLASSES)
_ID = {c: i for i, c in enumerate(CLASSES)}
_HERE = {w for k in _KINDS for w in CLOSED[k].split()}
_WORD_ID = dict.fromkeys(KOREAN_ENDINGS.split(), _ID["preposition"]) | {w: _ID[k] for table in (CLOSED_ELSEWHERE, CLOSED) for k in reversed(_KINDS) for w in table[k].split()}

_AGAIN, _CODE, _OPEN_AT = _ID["again"], _ID["code"], [0, *(_ID[f"open{i}"] for i in range(1, RUN + 1))]

#: The end of a segment among the tokens of a batch.
_END = "\0"
_KINDS_OF_TOKENS = re.compile(
    r"(?P<plain>[^\W\d_]++(?=[\s\0,;!?)]))"  # what most tokens are, so that the costly forms are tried on the rest only
    r"|(?P<link>h(?:tt|xx)ps?://[^\s\0]+|www\.[^\s\0]+|[\w-]{1,63}(?:(?:\.|\[\.\])[\w-]{1,63}){0,20}(?:\.|\[\.\])[a-z]{2,}(?:/[^\s\0]*|\?[^\s\0]*)?(?![\w.]))"
    r"|(?P<tag>[#@]\w[\w'’-]*)"
    r"|(?P<number>\d+(?:[.,:]\d+)*(?!\w))"
    r"|(?P<word>\w+(?:['’@]\w+)*)"
    r"|(?P<mark>[^\w\s])"
)
#: The same without groups, for cutting.
_TOKEN = re.compile(re.sub(r"\(\?P<\w+>", "(?:", _KINDS_OF_TOKENS.pattern))
_SENTENCE = re.compile(r"([.!?…])[\"')\]]*\s+")
_WIDE_SENTENCE = re.compile(r"([.!?…])[\"')\]]*\s+|([。！？])[」』”’）]*\s*")
_INVISIBLE = re.compile("[\u200b\ufeff\xad\u200c\u200d\u2060]")
_ODD_SPACES = re.compile("[\xa0\u202f\0]")
_WIDE = str.maketrans("。！？，、；：（）「」『』“”", ".!?,,;:()\"\"\"\"\"\"")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")
_CJK = "[\u30a0-\u30ff\u3400-\u9fff]"
_CHINESE = sorted((w for table in CLOSED_ELSEWHERE.values() for w in table.split() if re.fullmatch(_CJK + "+", w)), key=len, reverse=True)
#: A function word, a run of hiragana, a Korean word with its ending, or up to two other characters.
_PIECE = re.compile("(" + "|".join(_CHINESE) + ")|([\u3040-\u309f]+)|([\uac00-\ud7a3]+?)(" + "|".join(sorted(KOREAN_ENDINGS.split(), key=len, reverse=True)) + ")(?![\uac00-\ud7a3])|(" + _CJK + "(?:(?!" + "|".join(_CHINESE) + ")" + _CJK + ")?)")
_ITEM = re.compile(r"(?:[-*•]|\d+[.)])?\s*\[[^\]]*\]\([^)\s]*\)")
#: A source given behind a sentence: at most two words and one link.
_SOURCE = re.compile(r"\W*(?:\w+\W+){0,2}h(?:tt|xx)ps?://\S+$")
_APOSTROPHE = re.compile("['’]")
_LOOKALIKE = str.maketrans("013457@$", "oleastas")

_MACHINE = re.compile(
    r"^\s*(?:"
    r"```.*"  # a fence
    r"|[{}\[\]]+,?;?"  # brackets alone
    r"|\"[^\"]*\"\s*:\s*.*"  # a JSON member
    r"|(?:\d+|true|false|null|\"[^\"]*\"),?"  # a JSON item
    r"|[\w.$\[\]]+\s*(?:[-+*/|&]?=|:=|==)\s*\S.*"  # an assignment
    r"|(?:def|class|import|from|return|for|while|if|else|elif|try|function|const|let|var|public|private|fn|func|package|use|include)\b.*[:;{)(]\s*"
    r"|\[[\w .:-]+\]\s*"  # a section
    r"|[\w.]+\([^()]*\);?"  # a call
    r"|\|.*\|"  # a table row with outer bars
    r"|[-+|=:\s]{3,}"  # a rule
    r"|\$\s.*"  # a prompt
    r")\s*$"
)
_ROW = re.compile(r"\s*[^\s,;|\t]+(?:[,;\t][^\s,;|\t]*)+\s*$")  # fields without spaces
_FIELD_END = re.compile(r"[,;\t]")
_NUMERIC = re.compile(r"[-+]?\d[\d.:%/TZ+-]*")
_LOG_START = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d:\d\d)")
_LEVEL = re.compile(r"\b(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b")
_PAIR = re.compile(r"\b\w+=\S")
_LINKY = re.compile(r"h(?:tt|xx)ps?://|\.[a-z]{2,}(?:[/,?]|$)")


def _is_row(line: str, before: str, after: str) -> bool:
    """A table's row of fields without spaces: none is a tag, and one is a number or a neighbour has as many fields."""
    if not _ROW.match(line):
        return False
    fields = _FIELD_END.split(line.strip())
    if any(f[:1] in ("#", "@") for f in fields):
        return False
    return any(_NUMERIC.fullmatch(f) for f in fields) or any(_ROW.match(x) and len(_FIELD_END.split(x.strip())) == len(fields) for x in (before, after))


#: What may stand before a list: a time, a level, a name with a sign.
_BEFORE = re.compile(r"^\W*(?:\[?\d{4}-\d\d-\d\d[T ])?(?:\[?\d\d:\d\d(?::\d\d)?[\d.,Z+:\]-]*\s*)?(?:(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b\s*)?(?:[\w.-]+\s*[:=]\s*)?")
_FORMAL = re.compile(r"[\d=(){}<>\[\]\"`$\\_/]")
_WORDS = re.compile(r"[^\W\d_]+")


def is_word_list(line: str) -> bool:
    """Only words, separators and no formal signs behind what may stand before a list, and of the open words a quarter come again."""
    rest = line[_BEFORE.match(line).end() :]
    if _FORMAL.search(rest):
        return False
    words = _WORDS.findall(rest.lower())
    open_ = [w for w in words if w not in _WORD_ID]
    return len(open_) >= 4 and len(open_) >= 0.85 * len(words) and len(open_) - len(set(open_)) >= 0.25 * len(open_)


def is_machine(line: str, before: str = "", after: str = "") -> bool:
    """A line of a log, table, settings file or program, by its shape and, for rows of fields, the lines beside it."""
    if _LOG_START.match(line) or ("=" in line and _LEVEL.search(line) and _PAIR.search(line)):
        return not is_word_list(line)
    if not _MACHINE.match(line) and not _is_row(line, before, after):
        return False
    return not (_LINKY.search(line) and "=" not in line.partition("?")[0] and '"' not in line and "{" not in line) and not is_word_list(line)


# What a token is by itself, packed: class (0: an open word) | bits below | own class << 12 | number of its plain form << 20.
_WORD, _WHOLE, _STOP, _STRANGE, _ELSEWHERE = 1 << 8, 1 << 9, 1 << 10, 1 << 11, 1 << 18
_HIRAGANA = re.compile("[\u3040-\u309f]+")
_KNOWN_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "FULLWIDTH", "MASCULINE", "FEMININE", "MODIFIER")


class _Known(dict):
    """token -> packed; learned as they come, and forgotten between batches when there are too many."""

    def __init__(self) -> None:
        self.plain: dict[str, int] = {}
        self[_END] = _STOP

    def __missing__(self, s: str) -> int:
        kind = _KINDS_OF_TOKENS.match(s + " ").lastgroup
        if kind == "mark":
            out = _ID.get(s, _ID["other"])
        elif kind not in ("word", "plain"):
            out = _ID[kind]
        else:
            low = s.lower()
            c = _WORD_ID.get(low)
            if c is None and _HIRAGANA.fullmatch(s):
                c = _ID["preposition"] if len(s) < 3 else _ID["verb"]
            whole = c is not None
            if c is None and _APOSTROPHE.search(low):
                c = _WORD_ID.get(_APOSTROPHE.split(low)[0])
            plain = low.translate(_LOOKALIKE)
            caseless = s.lower() == s.upper()
            own = 0 if plain == low and "_" not in low and (caseless or s.islower()) else _ID["title"] if plain == low and "_" not in low else _ID["code"]
            out = (c or 0) | _WORD | (_WHOLE if whole else 0) | own << 12 | self.plain.setdefault(plain, len(self.plain)) << 20
            if not s.isascii() and s[0].isalpha() and not unicodedata.name(s[0], "").startswith(_KNOWN_SCRIPTS):
                out |= _STRANGE
            if whole and low not in _HERE:
                out |= _ELSEWHERE
        self[s] = out
        return out


_known = _Known()

# Kinds of segments. STRANGE: a sentence of another language, or of a script without listed words; LIKELY: a sentence by its shape; PROSE: one that may also train the model.
PLAIN, MACHINE, STRANGE, LIKELY, PROSE = range(5)
_ENDS = [_ID[x] for x in ".!?"]
_OPEN = [*(_ID[f"open{i}"] for i in range(1, RUN + 1)), _ID["title"], _ID["code"], _ID["again"]]
_ODD = [_ID[x] for x in ("link", "tag", "code", "other")]


def sentences(line: str, unspaced: bool = False) -> list[str]:
    """A line cut behind the marks that end sentences; quotes and brackets that close there belong to none."""
    if not unspaced:
        parts = _SENTENCE.split(line)
        if len(parts) == 1:
            return parts if line else parts[:0]
        return [a + b for a, b in zip(parts[::2], [*parts[1::2], ""], strict=True)]
    parts = _WIDE_SENTENCE.split(line)
    return [a + (b or c or "") for a, b, c in zip(parts[::3], [*parts[1::3], ""], [*parts[2::3], ""], strict=True)] if line else []


def pieces(text: str) -> Iterator[tuple[int, str | None, int, bool]]:
    """(paragraph, what is to be scored or None for machine text, characters, whether it counts without a token) of each segment, in order.

    A leading list item that is only a link is a segment of its own; a link given as the source of the sentence before it
    counts as that sentence does. Every character but white space between
    segments belongs to one segment.
    """
    fenced, paragraph = False, 0
    unspaced = False
    if not text.isascii():
        text = _ODD_SPACES.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFC", text)))
        unspaced = _UNSPACED.search(text) is not None
    elif _END in text:
        text = text.replace(_END, " ")
    lines = text.split("\n")
    fences = sum(x.lstrip().startswith("```") for x in lines)
    for at, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            paragraph += 1
            continue
        fence = bare.startswith("```")
        if fence or (fenced and not is_word_list(line)) or (not fenced and is_machine(line, lines[at - 1] if at else "", lines[at + 1] if at + 1 < len(lines) else "")):
            if fence:
                fences -= 1
                fenced = not fenced and fences > 0  # one that is never closed hides only itself
            yield paragraph, None, len(bare), True
            continue
        while m := _ITEM.match(bare):
            yield paragraph, m.group(), m.end(), True
            bare = bare[m.end() :].lstrip()
        cut = sentences(bare, unspaced)
        source = len(cut) > 1 and "://" not in cut[-2] and _SOURCE.match(cut[-1])
        for i, x in enumerate(cut[:-1] if source else cut):
            size = len(x) + (len(cut[-1]) if source and i == len(cut) - 2 else 0)
            yield paragraph, _PIECE.sub(lambda m: " " + " ".join(g for g in m.groups() if g) + " ", x).translate(_WIDE) if unspaced else x, size, False


def encode(texts: list[str | None]):
    """Of many texts: each one's number of segments and of class bytes, all classes (a segment's end by 0), and kind, characters and paragraph of every segment."""
    if len(_known) > 200_000:
        _known.clear()
        _known.__init__()
    cut = [list(pieces(t)) if t else [] for t in texts]
    flat = [p for c in cut for p in c]
    n = len(flat)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(len(texts), int), np.zeros(len(texts), int), none.astype(np.uint8), none.astype(np.uint8), none, none
    tokens = _TOKEN.findall(_END.join([p[1] or "" for p in flat]) + _END)
    code = np.fromiter(map(_known.__getitem__, tokens), np.int64, len(tokens))
    stop = code & _STOP != 0
    seg = np.cumsum(stop) - stop
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    cls, word = code & 0xFF, code & _WORD != 0
    open_ = word & (cls == 0)
    bare = np.bincount(seg[code & _WHOLE != 0], minlength=n) == 0

    # Open words since the last closed one, and those that stood before: in the segment, or (without closed words) among the text's last ones.
    so_far = np.cumsum(open_)
    run = so_far - np.maximum.accumulate(np.where(stop | (word & ~open_), so_far, 0))
    at = np.nonzero(open_)[0]
    name, s = code[at] >> 20, seg[at]
    order = np.argsort(name, kind="stable")
    prev = np.full(len(at), -1)
    same = name[order][1:] == name[order][:-1]
    prev[order[1:][same]] = order[:-1][same]
    before = np.maximum(prev, 0)
    again = (prev >= 0) & ((s[before] == s) | (bare[s] & (doc[s[before]] == doc[s]) & (np.arange(len(at)) - prev <= RECENT))) if len(at) else prev >= 0
    own, r = code[at] >> 12 & 0x3F, run[at]
    cls[at] = np.where(again, _AGAIN, np.where((own == _CODE) | ((own > 0) & (r == 1)), own, np.array(_OPEN_AT)[np.minimum(r, RUN)]))

    table = lambda ids: np.isin(np.arange(256), ids)
    per = lambda ids: np.bincount(seg[table(ids)[cls] & ~stop], minlength=n)
    closed, odd, repeats = per(range(1, len(_KINDS) + 1)), per(_ODD), per([_AGAIN])
    words = closed + per(_OPEN)
    size = np.bincount(seg, minlength=n) - 1
    ends = np.nonzero(stop)[0]
    finished = table(_ENDS)[cls[np.maximum(ends - 1, 0)]] & (size > 0)
    likely = (closed > 0) & (closed >= 0.15 * words) & finished
    prose = likely & (closed >= 0.2 * words) & (repeats <= np.maximum(1, 0.15 * words)) & (odd <= 1)
    strange = 2 * np.bincount(seg[code & _STRANGE != 0], minlength=n) > words
    strange |= prose & (3 * np.bincount(seg[code & _ELSEWHERE != 0], minlength=n) >= np.maximum(closed, 1))
    machine = np.array([p[1] is None for p in flat])
    kind = np.select([machine, strange, prose, likely], [MACHINE, STRANGE, PROSE, LIKELY], PLAIN).astype(np.uint8)

    keep = (size > 0) | np.array([p[3] for p in flat])
    cls = cls.astype(np.uint8)[keep[seg]]
    bytes_ = np.bincount(doc[seg[keep[seg]]], minlength=len(texts))
    chars, par = (np.array([p[i] for p in flat], np.int32)[keep] for i in (2, 0))
    return np.bincount(doc[keep], minlength=len(texts)), bytes_, cls, kind[keep], chars, par


def segments(text: str) -> list[tuple[int, int, int, bytes]]:
    """(paragraph, kind, characters, classes) of each segment of one text."""
    _, _, cls, kind, chars, par = encode([text])
    return list(zip(par.tolist(), kind.tolist(), chars.tolist(), bytes(cls).split(b"\0")[:-1], strict=True))


# --- the corpus --------------------------------------------------------------------------------------------

_ENCODED = "doc_id long, seq binary, kinds binary, chars binary, paragraphs binary"


def encoded(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a non-empty text: its segments' classes (each ended by 0), kinds, lengths and paragraphs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                count, size, *flat = encode(b.column(1).to_pylist())
                some = np.nonzero(count)[0]
                if len(some):
                    ends = [np.append(0, np.cumsum(n[some])) for n in (size, count)]
                    binary = lambda x, e, w: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(e * w), pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())  # noqa: E731, B023
                    cols = [binary(flat[0], ends[0], 1), binary(flat[1], ends[1], 1), binary(flat[2], ends[1], 4), binary(flat[3], ends[1], 4)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), *cols], names=["doc_id", "seq", "kinds", "chars", "paragraphs"])

    return documents.select(F.col(id).cast("long"), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(scan, _ENCODED)


def _unpack(b: pa.RecordBatch):
    """Of a batch: documents' ids, each token with its two predecessors and its segment, each segment's document, kind, length, paragraph."""
    ids = b.column(0)
    seqs, kinds, chars, pars = (b.column(k).to_pylist() for k in range(1, 5))
    x = np.frombuffer(b"".join(seqs), np.uint8).astype(np.int32)
    prev = np.concatenate(([0], x[:-1]))
    prev2 = np.where(prev == 0, 0, np.concatenate(([0, 0], x[:-2])))
    seg = np.cumsum(np.concatenate(([0], (x[:-1] == 0).astype(np.int64))))
    kind = np.frombuffer(b"".join(kinds), np.uint8)
    doc = np.repeat(np.arange(len(ids)), [len(k) for k in kinds])
    return ids, (prev2 * ALPHABET + prev) * ALPHABET + x, seg, doc, kind, np.frombuffer(b"".join(chars), np.int32), np.frombuffer(b"".join(pars), np.int32)


def trigram_counts(coded: DataFrame) -> DataFrame:
    """gram, n over the PROSE segments of all documents: at most ALPHABET**3 rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for b in batches:
            if b.num_rows:
                _, gram, seg, _, kind, _, _ = _unpack(b)
                total += np.bincount(gram[kind[seg] == PROSE], minlength=ALPHABET**3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["gram", "n"])

    return coded.mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def surprisal(counts: list[tuple[int, int]], weight: float = 2.0) -> np.ndarray:
    """-log P of each trigram, interpolated with bigrams, unigrams and 0.5 for each class (Dirichlet weights)."""
    tri = np.zeros(ALPHABET**3)
    for gram, n in counts:
        tri[gram] = n
    tri = tri.reshape((ALPHABET,) * 3)
    bi, uni = tri.sum(0), tri.sum((0, 1)) + 0.5
    p1 = uni / uni.sum()
    p2 = (bi + weight * p1) / (bi.sum(1, keepdims=True) + weight)
    p3 = (tri + weight * p2) / (tri.sum(2, keepdims=True) + weight)
    return -np.log(p3).astype(np.float64).ravel()


def _segment_scores(b: pa.RecordBatch, model: np.ndarray):
    """Mean surprisal of each segment, the tokens it is a mean of, and its share of words that come again; sentences get the mean of all sentences of their paragraph."""
    ids, gram, seg, doc, kind, chars, par = _unpack(b)
    n = len(kind)
    total, tokens = np.bincount(seg, model[gram], n), np.bincount(seg, minlength=n)
    group = np.unique(np.stack([doc, par]), axis=1, return_inverse=True)[1].ravel() if n else np.zeros(0, int)
    likely = kind >= LIKELY
    size = group.max() + 1 if n else 0
    ptotal, ptokens = np.bincount(group[likely], total[likely], size), np.bincount(group[likely], tokens[likely], size)
    score = np.where(likely, (ptotal / np.maximum(ptokens, 1))[group], total / np.maximum(tokens, 1))
    repeats = np.bincount(seg, gram % ALPHABET == _AGAIN, n) / np.maximum(tokens, 1)
    return ids, doc, kind, chars, score, np.where(likely, ptokens[group], tokens) if n else tokens, repeats


#: A surprisal, in nats a token, that the classes of ordinary sentences may have in any corpus: a perplexity of 9.
NORMAL = 2.2
#: Tokens at which the bound for an abnormal mean lies 1.4 times as far out as for a long text.
SHORT = 8
_BINS = 2000  # of 0.01 nats


def score_histogram(coded: DataFrame, model: np.ndarray) -> list[int]:
    """Characters of PROSE segments by surprisal, in bins of 0.01 nats, over all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BINS, np.int64)
        for b in batches:
            if b.num_rows:
                _, _, kind, chars, score, *_ = _segment_scores(b, model)
                p = kind == PROSE
                total += np.bincount(np.minimum((score[p] * 100).astype(int), _BINS - 1), chars[p], _BINS).astype(np.int64)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bin", "n"])

    out = [0] * _BINS
    for k, n in coded.mapInArrow(scan, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most _BINS rows
        out[k] = n
    return out


def thresholds(histogram: list[int], spread: float = 5.0) -> tuple[float, float, float]:
    """Lowest, usual and highest surprisal that is still normal: the median, less or plus `spread` times its distance to the outer tenths.

    A corpus of few, alike sentences says little of what prose may look like, so NORMAL is never abnormally high.
    """
    n = np.cumsum(histogram)
    if not n[-1]:
        return 0.0, NORMAL / 2, NORMAL
    q = [float(np.searchsorted(n, n[-1] * p) + 0.5) / 100 for p in (0.1, 0.5, 0.9)]
    return q[1] - spread * (q[1] - q[0]), q[1], max(q[1] + spread * (q[2] - q[1]), NORMAL)


def page_scores(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chars, machine_chars, odd_chars of every document with a non-blank text.

    odd_chars stand in segments of abnormal perplexity that aren't machine text. Documents with a null, empty or
    blank text don't appear; repeated ids and texts are scored each by itself; an empty table gives no rows.
    """
    coded = stored(encoded(documents, id, text), "classes")
    model = surprisal([tuple(r) for r in trigram_counts(coded).collect()])  # bounded by ALPHABET**3
    low, usual, high = thresholds(score_histogram(coded, model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, doc, kind, chars, score, tokens, repeats = _segment_scores(b, model)
                # The mean over few tokens strays further.
                most = usual + (high - usual) * np.sqrt(1 + SHORT / np.maximum(tokens, 1))
                odd = (kind != MACHINE) & np.where(kind == STRANGE, repeats > 0.5, (score > most) | (score < low))
                n = len(ids)
                sums = [np.bincount(doc, chars * m, n).astype(np.int64) for m in (1, kind == MACHINE, odd)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, sums)], names=["doc_id", "chars", "machine_chars", "odd_chars"])

    return coded.mapInArrow(scan, "doc_id long, chars long, machine_chars long, odd_chars long")


def stuffed(documents: DataFrame, id: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """doc_id of the pages of which more than `share` of the characters are keyword lists, links or tags."""
    return page_scores(documents, id, text).filter(F.col("odd_chars") > share * F.col("chars")).select("doc_id")
