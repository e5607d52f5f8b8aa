"""Personal information in free text: typed placeholders with linked pseudonyms.

Validated numbers and the dates in them are permuted within their format by a
keyed Feistel network: prefixes that say nothing about a person stay, check
signs are made anew, and all spellings of a value get the same pseudonym in all
documents. Names are found by a lexicon that Spark counts from the texts
themselves, beginning with the given names known to the office; its frequent
part goes to all tasks, the rest meets the texts that hold it in a join.

A date that stands alone is no mention of personal information, and every
character outside of mentions is kept; so only dates inside numbers change.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import hmac
import re
import secrets
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.tables import stored

TYPES = ("name", "email", "phone", "identity", "address")
#: Learned names with this share of all name counts go to all tasks, so no more than its inverse.
HOT_SHARE = 1 / 65536
#: Times that a name must have been seen in the place of one.
LEAST_SEEN = 2
#: The Spark setting that holds the secret key of the pseudonyms.
KEY_SETTING = "spark.sparkloom.pseudonym.key"

# ---- fixed values: words that mark the kinds of personal information ----
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Sir Herr Herrn Frau Hr Fr M Mme Mlle Monsieur Madame Sr Sra Srta Señor Señora Don Doña Dra".split()
PARTICLES = "von van de del der den di da du dos das la le zu zum".split()
HAN_HONORIFICS = "先生|女士|小姐|老师|博士|教授|经理|主任|同学|同志|医生"
HAN_COMPOUND = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 令狐 百里 呼延 西门 轩辕".split()
HAN_SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫房解应宗丁宣邓郁单杭洪包诸左石崔吉龚程邢裴陆荣翁荀甄曲封储靳段巫乌焦巴弓牧山谷车侯全班仰秋仲伊宫宁仇栾甘厉祖武符刘景詹束龙叶司黎薄白蒲邰从鄂赖卓蔺屠蒙池乔翟谭姬申扶冉桑桂牛寿通边燕尚农温庄晏柴瞿阎慕连习鱼容向古易廖耿满匡国文寇广欧沃利越师巩聂晁敖冷辛那简饶空曾沙丰关查游权盖益桓公闻"
STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Court|Ct\.?|Drive|Dr\.?|Way|Close|Place|Pl\.?|Square|Sq\.?|Terrace|Boulevard|Blvd\.?|Crescent|Gardens|Mews|Walk|Parade|Row|Quay|Circle|Alley|Wharf|Parkway|Pkwy\.?|Highway|Hwy\.?)"
STREET_FR = r"(?:rue|avenue|av\.|boulevard|bd\.?|impasse|quai|place|chemin|allée|allées|route|cours|square|passage|sentier|villa|faubourg)"
STREET_ES = r"(?:Calle|C/|Plaza|Pza\.?|Avenida|Avda\.?|Av\.|Paseo|P\.º|Camino|Ronda|Travesía|Carrera|Cuesta|Callejón|Glorieta)"
STREET_DE = r"(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer|hof|steig|pfad|chaussee|markt|graben|berg|garten|winkel)"
ID_LABEL = r"(?:SSN(?:/ID)?|social security(?: number| no\.?)?|passport(?: number| no\.?)?|ID(?![A-Za-z])(?: card)?(?: number| no\.?)?|identity (?:card|number)(?: no\.?)?|national insurance(?: number| no\.?)?|NI(?:NO|(?![A-Za-z]))|Ausweis(?:nummer)?|Personalausweis(?:nummer)?|Reisepass(?:nummer)?|Sozialversicherungsnummer|Steuer-?ID|num[ée]ro d[’']identité|num[ée]ro de sécurité sociale|passeport(?: n°)?|carte d[’']identité(?: n°)?|NIR|DNI|NIE|NIF|CURP|pasaporte(?: n\.?º)?|documento(?: de identidad)?(?: n\.?º)?|身份证号码|身份证号|身份证|证件号码|证件号|证件|护照号码|护照号|护照|社保号|the applicant \()"

# ---- patterns ----
AT = r"(?:\s?[@＠]\s?|\s?[(\[{<]\s?(?:at|AT|@|＠|arroba|ät)\s?[)\]}>]\s?)"
DOT = r"(?:[.．]|\s?[(\[{]\s?(?:dot|DOT|\.|punkt|point|punto)\s?[)\]}]\s?)"
LOCAL, LABEL = r"[A-Za-z0-9][A-Za-z0-9._%+'-]*", r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{LOCAL}{AT}{LABEL}(?:{DOT}{LABEL})*{DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])|{LOCAL}\s+(?:at|AT)\s+{LABEL}(?:\s+(?:dot|DOT)\s+{LABEL})*\s+(?:dot|DOT)\s+[A-Za-z]{{2,24}}(?![A-Za-z0-9]))")
D = r"[0-9０-９]"
SEP = r"[   ./·()（）\-‐‑–－]"
NUMBER = re.compile(rf"(?<![\w０-９.,@#/\-+])(?:[+＋]\s?)?[(（]?{D}(?:{SEP}{{0,3}}{D}){{6,18}}(?![\w０-９@]|[.,\-/]{D})|(?<=[　-〿一-鿿：，])(?:[+＋]\s?)?[(（]?{D}(?:{SEP}{{0,3}}{D}){{6,18}}(?![A-Za-z0-9０-９@]|[.,\-/]{D})")
PHONE_LABEL = re.compile(r"(?:\b(?:(?i:tel|phone|fon|mobile|mobil|cell|call|fax|handy|móvil|portable|téléphone|teléfono|telefon)|T)|电话|手机|座机|传真|致电|拨打)\s*[.:：]?\s*$|(?:Reach .{2,40} on|unter|joindre .{2,40} au|llamar a .{2,40} al|(?:^|[.!?:]\s|\n)is)\s*$")
ID_CODE = rf"(?=[A-Za-z0-9 .\-]*[0-9])[A-Za-z0-9](?:[ .\-]?[A-Za-z0-9]){{5,21}}"
LABELLED_ID = re.compile(rf"(?<![A-Za-zÀ-ÿ]){ID_LABEL}\s*(?:is|lautet|est|es|number|no\.|Nr\.?|n°|是|为|为：)?\s*[:：#]?\s*({ID_CODE})(?![A-Za-z0-9])", re.I)
NAMED_ID = re.compile(r"(?<![A-Za-z0-9])((?=[A-Z0-9 .\-]*[0-9])[A-Z0-9](?:[ .\-]?[A-Z0-9]){5,21})\s+(?:as|is|was)\s+(?:the|an?|his|her|their|my|our)\s+(?:identity|passport|ID(?![A-Za-z])|social security|national insurance|insurance)")
FREE_ID = re.compile(
    r"(?<![A-Za-z0-9\-.])(?:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{2}-\d{4}|[1278] ?\d{2} ?(?:0[1-9]|1[0-9]|[2-9]\d) ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[TRWAGMYFPDXBNJZSQVHLCKE])(?![A-Za-z0-9\-])"
    r"|(?<![0-9A-Za-z])[1-9]\d{5}([- ]?)(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\1\d{3}[0-9Xx](?![0-9A-Za-z])"
)
DATE = re.compile(r"(?<!\d)(?:19|20)\d{2}([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?!\d)|(?<!\d)(?:0?[1-9]|[12]\d|3[01])([./])(?:0?[1-9]|1[0-2])\2(?:19|20)\d{2}(?!\d)")
CAP = r"[A-ZÀ-Ý][\w’'\-]*\.?"
TOWN = r"(?:(?:Port|Puerto|Bad|San|Santa|Saint|Sainte|St\.?|La|Le|Los|Las|El|New|Old|Upper|Lower|North|South|East|West|Villa|Ciudad|Mount|Fort|Lake|Great|Little)[\s-])?[A-ZÀ-Ý][\w’'\-]+"
ADDRESSES = (
    re.compile(rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room|Floor|House|Studio|No\.?)\s#?\w+[,\s]\s*)?(?<![\w.,\-])\d{{1,5}}(?:\s?[A-Za-z])?(?:[-–/]\d{{1,4}})?,?\s(?:[NSEW]\.?\s)?(?:{CAP}\s){{1,4}}{STREET_EN}(?![\w])(?:,?\s(?:Flat|Apt\.?|Unit|Suite)\s#?\w+)?(?:,?\s+{TOWN}\s(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|\d{{5}})(?!\d))?"),
    re.compile(rf"(?<!\w)(?:P\.?\s?O\.?\s?Box|Post Office Box|Postfach|B\.?P\.?|Boîte postale|Apartado(?: de correos)?|Apdo\.?(?: de correos)?|PO-?Box)\s(?:No\.?\s|n[.°º]*\s)?\d[\d ]*\d?(?:,?\s+{TOWN}\s(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|\d{{5}})(?!\d)|,?\s+\d{{5}}\s{TOWN})?", re.I),
    re.compile(rf"(?<![\w.,])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s{STREET_FR}\s(?:(?:de\sla|de\sl[’']|des|du|de|d[’']|la|le|les)\s?)?[A-ZÀ-Ý][\w’'\-]*(?:\s(?:de\s|la\s|des\s|du\s)?[A-ZÀ-Ý][\w’'\-]*)*(?:,?\s+\d{{5}}\s{TOWN})?", re.I),
    re.compile(rf"(?<!\w){STREET_ES}\s?(?:(?:de\slas?|de\slos|del|de|la|el|los|las)\s)*(?:[A-ZÀ-Ý][\w’'\-]*\s?)+,?\s?(?:n\.?º\s?)?\d{{1,4}}(?:,?\s\d{{1,2}}\.?[ºª]\s?\w+|,\s(?:bajo|ático|entresuelo)(?:\s\w+\.?)?)?(?:,?\s+\d{{5}}\s{TOWN})?"),
    re.compile(rf"(?<!\w)(?:(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|Bei der|Hinter dem|Alte|Alter|Altes|Neue|Neuer|Große|Kleine|Obere|Untere)\s)[A-ZÄÖÜ][\wß\-]+(?:\s[A-ZÄÖÜ][\wß\-]+)?|[A-ZÄÖÜ][\wß\-]*?-?{STREET_DE}|[A-ZÄÖÜ][\wß\-]+er\s[A-ZÄÖÜ][\wß]*?{STREET_DE}|[A-ZÄÖÜ][\wß\-]+[-\s](?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm|Ufer))\s\d{{1,4}}\s?[a-z]?(?![\w])(?:[-–/]\d+)?(?:,?\s+\d{{5}}\s{TOWN})?"),
    re.compile(rf"(?<!\w)\d{{5}}\s[A-ZÀ-Ý][\w\-]+,\s(?:[A-ZÄÖÜ][\wß\-]*?{STREET_DE}\s\d{{1,4}}\s?[a-z]?|\d{{1,4}}\s{STREET_FR}\s[\w’'\- ]+)(?!\w)"),
)
HAN = "一-鿿"
HAN_ADDRESS = re.compile(
    rf"(?:[{HAN}]{{2,8}}?(?:省|自治区))?(?:[{HAN}]{{2,6}}?市)?(?:[{HAN}]{{1,6}}?(?:区|县|镇|乡|新区|开发区|街道))*[{HAN}]{{1,8}}?(?:路|街|巷|大道|道|弄|胡同|里|村|大街)\s?[{D[1:-1]}零一二三四五六七八九十百]{{1,6}}\s?(?:号|弄)(?:附?[{D[1:-1]}]{{1,4}}(?:号楼|号院|号|栋|幢|座|楼|单元|室|层|弄))*"
    rf"|[{HAN}]{{2,8}}(?:市|区|县|镇)?(?:邮政)?信箱\s?[{D[1:-1]}]{{1,6}}\s?号?"
)
HAN_LEADS = (
    re.compile(r"^.*(?:寄到|寄往|寄至|寄给|送到|送至|发到|搬到|搬至|搬去|迁至|迁到|地址是|地址为|住在|住址|位于|工位在|地点在|设在|家在|就在|邮寄|改为|改成)(?=[一-鿿]{2})"),
    re.compile(r"^.*?(?:在|到|至|是|请|往|于|为)(?=[一-鿿]{2,}[市省区县路街巷道])"),
)
#: Words, in lower case, one of which any match of a pattern holds; so most patterns never run on most texts.
STREET_WORDS = ((), ("box", "postfach", "bp", "b.p", "boîte", "apartado", "apdo"), ("rue ", "avenue ", "av. ", "boulevard ", "bd", "impasse ", "quai ", "place ", "chemin ", "allée", "route ", "cours ", "square ", "passage ", "sentier ", "villa ", "faubourg "), ("calle", "c/", "plaza", "pza", "avenida", "avda", "av.", "paseo", "p.º", "camino", "ronda", "travesía", "carrera", "cuesta", "glorieta"), ("weg ", "straße ", "strasse ", "str. ", "gasse ", "platz ", "allee ", "ring ", "damm ", "ufer ", "hof ", "steig ", "pfad ", "chaussee ", "markt ", "graben ", "berg ", "garten ", "winkel ", "am ", "an de", "im ", "in der ", "zum ", "zur ", "auf de", "unter den ", "bei der ", "hinter dem ", "alte", "neue", "große", "kleine", "obere", "untere"))
STREET_WORDS += ((*(w for w in STREET_WORDS[4] if w in ("weg ", "straße ", "strasse ", "str. ", "gasse ", "platz ", "allee ", "ring ", "damm ", "ufer ", "hof ", "steig ", "pfad ", "chaussee ", "markt ", "graben ", "berg ", "garten ", "winkel ")), *STREET_WORDS[2]),)
#: Those of them that never stand behind a letter.
WORD_STARTS = ("am ", "an de", "im ", "in der ", "zum ", "zur ", "auf de", "unter den ", "bei der ", "hinter dem ", "alte", "neue", "große", "kleine", "obere", "untere", "calle", "plaza", "camino", "ronda", "carrera", "cuesta")
ID_WORDS = ("ssn", "social sec", "passport", "ident", "insurance", "nino", "ausweis", "reisepass", "versicherungsn", "steuer", "sécurité", "passeport", "nir", "dni", "nie", "nif", "curp", "pasaporte", "documento", "身份证", "证件", "护照", "社保", "applicant (")
SHORT_ID = re.compile(r"(?<![A-Za-zÀ-ÿ])(?:ID|NI)(?![A-Za-z])", re.I)
AT_WORD = re.compile(r"[(\[{<]\s?(?:at|arroba|ät)\s?[)\]}>]")
MANY_DIGITS = re.compile(r"\d(?:[\W_]{0,3}\d){5}")
EN_STREET = re.compile(rf"{CAP}\s{STREET_EN}(?!\w)")
OTHER_SPACE = re.compile(r"[^\S ]")
LETTER = re.compile(r"[a-zà-ÿ]")
WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?")
LATIN_NAME = re.compile(r"[A-Za-zÀ-ɏ’'\-.]+$")
MAIL_NAMES = re.compile(r"^([a-z]{3,})[._-]([a-z]{3,})\d*$")


def overlaps(spans: list[tuple[int, int, str]], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b, _ in spans)


def digits_of(text: str) -> str:
    """The digits of a text, full-width ones as ASCII."""
    return "".join(str(int(c)) for c in text if c.isdigit() and c.isdecimal())


def is_phone(text: str, raw: str, start: int) -> bool:
    """Whether a run of digits has the build of a telephone number, or a label says so."""
    digits = digits_of(raw)
    n = len(digits)
    if raw.lstrip()[0] in "+＋" or digits.startswith("00"):
        return 9 <= n <= 16
    before = text[max(0, start - 60) : start]
    if PHONE_LABEL.search(before):
        return 7 <= n <= 15
    if DATE.search(raw) or re.search(r"(?:19|20)\d{2}-\d{2}-\d{2}", raw):
        return False
    if re.search(r"(?:SSN|ID|Serial|batch|no\.|Charge|lot|lote|lots?|offset|Row|批次号|编号|流水|订单)\W*(?:est|is|是)?\s*$", before, re.I):
        return False
    plain = raw.translate(str.maketrans("０１２３４５６７８９（）－", "0123456789()-"))
    if digits[0] == "0":
        return 9 <= n <= 12 and (not re.fullmatch(r"\d+", plain) or n >= 10)
    if re.fullmatch(r"\(?[2-9]\d{2}\)?[-. ]?\d{3}[-. ]\d{4}|1[-. ]?\(?[2-9]\d{2}\)?[-. ]?\d{3}[-. ]?\d{4}", plain):
        return bool(re.search(r"\D", plain)) or n == 11
    if re.fullmatch(r"1[3-9]\d[- ]?\d{4}[- ]?\d{4}", plain):
        return True
    return bool(re.fullmatch(r"[67]\d{2}[ -.]?\d{2}[ -.]?\d{2}[ -.]?\d{2}|[67]\d{2}[ -.]\d{3}[ -.]\d{3}", plain)) and n == 9


def strip_prefix(match: re.Match) -> int:
    """Start of a Chinese address without the words that lead to it."""
    for pattern in HAN_LEADS:
        lead = pattern.match(match.group())
        if lead and lead.end() < len(match.group()):
            return match.start() + lead.end()
    return match.start()


class Either:
    """Whether something is in one of two sets."""

    def __init__(self, *sets: set[str]):
        self.sets = sets

    def __contains__(self, x: str) -> bool:
        return any(x in s for s in self.sets)


class Lexicon:
    """Given and family names in lower case; Chinese given names."""

    def __init__(self, given: set[str], family: set[str], han_given: set[str]):
        self.given, self.family, self.han_given = given, family, han_given
        self.titles = {t.lower() for t in TITLES}
        self.words = None
        both = "|".join(HAN_COMPOUND)
        self.lengths = sorted({len(x) for x in han_given}, reverse=True)
        self.surname = re.compile(f"(?:{both}|[{HAN_SURNAMES}])")
        self.han_marked = re.compile(
            rf"(?<=联系人：)(?:{both}|[{HAN_SURNAMES}])[{HAN}]{{1,2}}(?=[\s，,。]|{HAN_HONORIFICS})|(?<=请联系)(?:{both}|[{HAN_SURNAMES}])[{HAN}]{{1,2}}(?=[\s，,]|{HAN_HONORIFICS})"
            rf"|(?<=[，,]找)(?:{both}|[{HAN_SURNAMES}])[{HAN}]{{1,2}}(?=即可|{HAN_HONORIFICS})|(?<=我叫)(?:{both}|[{HAN_SURNAMES}])[{HAN}]{{1,2}}(?=[，,。]|{HAN_HONORIFICS})"
            rf"|(?:{both})[{HAN}]{{0,2}}(?={HAN_HONORIFICS})|(?<![{HAN}])[{HAN_SURNAMES}][{HAN}]{{0,2}}(?={HAN_HONORIFICS})"
        )

    def kinds_in(self, low: str) -> set[str]:
        """What a text in lower case may hold: kinds of names, identity numbers and address patterns (by number)."""
        if self.words is None:
            import ahocorasick

            kinds: dict[str, set[str]] = {}
            marked = [("latin", self.given | self.family), ("han", self.han_given | set(HAN_HONORIFICS.split("|")) | {"联系", "我叫", "找"}), ("identity", set(ID_WORDS))]
            marked.append(("latin", {f"{sign}{t}{dot}" for t in self.titles for sign in " («“\"'：:>[" for dot in (" ", ". ")}))
            marked += [(str(i), {w for w in words if w not in WORD_STARTS}) for i, words in enumerate(STREET_WORDS)]
            for kind, words in marked:
                for w in words:
                    kinds.setdefault(w, set()).add(kind)
            starts: dict[str, set[str]] = {}
            for i, words in enumerate(STREET_WORDS):
                for w in {*words} & {*WORD_STARTS}:
                    starts.setdefault(w, set()).add(str(i))
            self.words = ahocorasick.Automaton()
            for w in {*kinds, *starts}:
                self.words.add_word(w, (tuple(kinds.get(w, ())), tuple(starts.get(w, ())), len(w)))
            self.words.make_automaton()
        found: set[str] = set()
        # letters that patterns without regard to case take for s and i
        plain = " " + OTHER_SPACE.sub(" ", low).replace("ſ", "s").replace("i̇", "i").replace("ı", "i")
        for end, (own, behind, n) in self.words.iter(plain):
            found.update(own)
            if behind and not LETTER.match(plain[end - n]):
                found.update(behind)
        return found

    def __getstate__(self):
        return self.__dict__ | {"words": None}

    def with_words(self, more: dict[str, list[str]]) -> Lexicon:
        """This lexicon and the ``more`` rare names that one text holds."""
        out = Lexicon.__new__(Lexicon)
        given, family, han = (set(more.get(k) or ()) for k in ("given", "family", "han"))
        kinds = {kind for kind, names in (("latin", given | family), ("han", han)) if names}
        out.__dict__ |= self.__dict__ | {"given": Either(self.given, given), "family": Either(self.family, family), "han_given": Either(self.han_given, han)}
        out.lengths = sorted({*self.lengths, *map(len, han)}, reverse=True)
        out.kinds_in = lambda low: self.kinds_in(low) | kinds
        return out

    def han(self, text: str):
        """(start, end) of Chinese names from left to right: a surname and a known given name, or what a mark says is a name."""
        found = [(m.start(), 1, m.end()) for m in self.han_marked.finditer(text)]
        at = 0
        while m := self.surname.search(text, at):
            at = m.start() + 1
            for end in (m.end(), m.start() + 1):
                names = [end + n for n in self.lengths if text[end : end + n] in self.han_given]
                if names:
                    found.append((m.start(), 0, names[0]))
                    break
        upto = 0
        for start, _, end in sorted(found):
            if start >= upto:
                upto = end
                yield start, end

    def latin(self, text: str):
        """(start, end) of Latin names: given and family name in any order and case, with initials, or a family name after a title."""
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        low = [w[2].rstrip(".").replace("’", "'").lower() for w in words]
        n, at = len(words), 0

        def gap(i: int) -> str:
            return text[words[i][1] : words[i + 1][0]] if i + 1 < n else "\0"

        def whole(i: int) -> tuple[int, int]:
            a, b, w = words[i]
            return a, b - w.endswith(".")

        def initial(i: int) -> bool:
            return len(low[i]) == 1 and words[i][2][0].isupper()

        def family(i: int, capital: bool) -> bool:
            if low[i] in self.family:
                return True
            return capital and len(low[i]) > 2 and words[i][2][0].isupper() and low[i] not in self.titles

        def skip(j: int) -> int:
            while j + 1 < n and low[j] in PARTICLES and gap(j) in (" ", " "):
                j += 1
            return j

        while at < n:
            w, i = low[at], at
            title = w in self.titles and words[at][2][0].isupper() and gap(at) in (" ", "\n", " ") and (len(w) > 1 or words[at][2].endswith("."))
            if title:
                i += 1
            first = skip(i)
            given = i < n and low[i] in self.given
            start = whole(i)[0] if i < n else 0
            if i < n and (given or initial(i)) and gap(i) in (" ", " ", "") and i + 1 < n and (gap(i) != "" or initial(i)):
                j = i + 1
                while j < n - 1 and (initial(j) or low[j] in self.given) and gap(j) in (" ", " ") and not (low[j] in self.family and low[j] not in self.given):
                    j += 1
                j = skip(j)
                if family(j, given and words[i][2][0].isupper()) and (given or low[j] in self.family):
                    yield start, whole(j)[1]
                    at = j + 1
                    continue
            if i + 1 < n and (low[i] in self.family) and gap(i) == ", " and (low[i + 1] in self.given or initial(i + 1)) and (low[i + 1] in self.given or words[i + 1][2].endswith(".")):
                end = whole(i + 1)[1]
                if i + 2 < n and initial(i + 2) and words[i + 2][2].endswith(".") and gap(i + 1) == " ":
                    end = words[i + 2][1]
                yield start, end
                at = i + 2
                continue
            if i + 1 < n and low[i] in self.family and gap(i) == " " and (low[i + 1] in self.given and words[i][2].isupper() or initial(i + 1) and words[i + 1][2].endswith(".")):
                yield start, words[i + 1][1] if initial(i + 1) else whole(i + 1)[1]
                at = i + 2
                continue
            if title and first < n and family(first, True) and (low[first] in self.family or words[first][2][1:].islower() or words[first][2].isupper()):
                yield whole(i)[0], whole(first)[1]
                at = first + 1
                continue
            at += 1


def mentions(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal information in a text, in order and without overlap."""
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    if "@" in low or "＠" in low or "dot" in low or AT_WORD.search(low):
        for m in EMAIL.finditer(text):
            if not re.search(r"[@＠]\s?[\d.]+$", m.group()):
                spans.append((m.start(), m.end(), "email"))
    kinds = lexicon.kinds_in(low)
    if re.search(r"\d", text):
        long = bool(MANY_DIGITS.search(text))
        if "identity" in kinds or SHORT_ID.search(text):
            for m in NAMED_ID.finditer(text):
                if not overlaps(spans, *m.span(1)):
                    spans.append((*m.span(1), "identity"))
            for m in LABELLED_ID.finditer(text):
                a, b = m.span(1)
                b -= len(text[a:b]) - len(re.sub(r"(?:\s[a-z]+)+$", "", text[a:b]))
                if sum(c.isdigit() for c in text[a:b]) >= 5 and not overlaps(spans, a, b):
                    spans.append((a, b, "identity"))
        if long:
            for m in FREE_ID.finditer(text):
                if not overlaps(spans, *m.span()):
                    spans.append((*m.span(), "identity"))
        if "号" in low or "弄" in low or "信箱" in low:
            for m in HAN_ADDRESS.finditer(text):
                a = strip_prefix(m)
                if not overlaps(spans, a, m.end()):
                    spans.append((a, m.end(), "address"))
        for i, pattern in enumerate(ADDRESSES):
            if str(i) in kinds if i else EN_STREET.search(text):
                for m in pattern.finditer(text):
                    if not overlaps(spans, *m.span()):
                        spans.append((*m.span(), "address"))
        if long:
            for m in NUMBER.finditer(text):
                a, b = m.span()
                raw = m.group()
                if raw[0] in "(（" and not re.search(r"[)）]", raw):
                    a, raw = a + 1, raw[1:]
                if is_phone(text, raw, a) and not overlaps(spans, a, b):
                    spans.append((a, b, "phone"))
    if "han" in kinds:
        for a, b in lexicon.han(text):
            if not overlaps(spans, a, b):
                spans.append((a, b, "name"))
    if "latin" in kinds:
        for a, b in lexicon.latin(text):
            if not overlaps(spans, a, b):
                spans.append((a, b, "name"))
    return sorted(spans)


# ---- pseudonyms ----


@functools.lru_cache(65536)
def permuted(digits: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the digit strings of one length: an unbalanced Feistel network of 10 rounds."""
    n = len(digits)
    if n < 2:
        return str((int(digits or 0) + _round(key, tweak, 0, 0, 10)) % 10) if digits else ""
    u = n // 2
    v = n - u
    a, b = int(digits[:u]), int(digits[u:])
    for i in range(10):  # halves take turns, each within its own size
        if i % 2:
            b = (b + _round(key, tweak, i, a, 10**v)) % 10**v
        else:
            a = (a + _round(key, tweak, i, b, 10**u)) % 10**u
    return f"{a:0{u}d}{b:0{v}d}"


def _round(key: bytes, tweak: str, i: int, half: int, size: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}|{i}|{half}".encode(), hashlib.sha256)[:16]) % size


def permuted_range(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): the digits are permuted until they fall into it again."""
    width = len(str(size - 1))
    while True:
        value = int(permuted(f"{value:0{width}d}", key, tweak))
        if value < size:
            return value


FIRST_DAY = datetime.date(1900, 1, 1)
DAYS = (datetime.date(2100, 1, 1) - FIRST_DAY).days


def permuted_date(day: datetime.date, key: bytes) -> datetime.date:
    """Another day between 1900 and 2099."""
    return FIRST_DAY + datetime.timedelta(permuted_range((day - FIRST_DAY).days, DAYS, key, "date")) if 0 <= (day - FIRST_DAY).days < DAYS else day


def check_sign(seventeen: str) -> str:
    """Check sign of an 18-place resident number (ISO 7064, modulus 11-2)."""
    total = sum(int(d) * (2 ** (17 - i) % 11) for i, d in enumerate(seventeen))
    return "10X98765432"[total % 11]


def permuted_like(digits: str, key: bytes, tweak: str, valid) -> str:
    """Another digit string of the same length that is ``valid`` as this one is: permuted until it is, so still one to one."""
    new = permuted(digits, key, tweak)
    while not valid(new):
        new = permuted(new, key, tweak)
    return new


# ---- fixed values: country codes of one and two places (all others have three); control letters; prefixes that are not issued ----
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
SPANISH_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NINO_FIRST, NINO_SECOND = "ABCEGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNPRSTWXYZ"
NINO_UNUSED = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
NINO_PREFIXES = [a + b for a in NINO_FIRST for b in NINO_SECOND if a + b not in NINO_UNUSED]


def phone_parts(value: str) -> tuple[str, str]:
    """The digits before the national number (international prefix, country code, trunk zero) and the number itself."""
    digits = digits_of(value)
    lead = ""
    if value.lstrip(" (（")[:1] in ("+", "＋") or digits.startswith("00"):
        lead = "00" if digits.startswith("00") else ""
        rest = digits[len(lead) :]
        code = next((rest[:n] for n in (1, 2) if rest[:n] in COUNTRY_CODES), rest[:3])
        lead += code
    elif len(digits) == 11 and digits[0] == "1" and digits[1] in "2" or len(digits) == 11 and digits[0] == "1" and re.match(r"1[-. (]", value.strip()):
        lead = "1"  # the country code of North America, written without a plus
    zeros = len(digits[len(lead) :]) - len(digits[len(lead) :].lstrip("0"))
    if len(digits) - len(lead) - zeros < 4:
        zeros = 0
    return digits[: len(lead) + zeros], digits[len(lead) + zeros :]


def phone_shape(number: str) -> tuple:
    """What a national number must keep: that it is a Chinese mobile, North American or French and Spanish mobile number, or just that it begins with no zero."""
    if len(number) == 11 and re.match("1[3-9]", number):
        return ("mobile", 11)
    if len(number) == 10 and re.match(r"[2-9]\d{2}[2-9]", number):
        return ("american", 10)
    return (number[:1] != "0", len(number) == 9 and number[:1] in "67")


def resident_number(code: str, key: bytes) -> str | None:
    """An 18-place number with a valid date: region, date and order permuted, the check sign made anew if it was right."""
    if not re.fullmatch(r"\d{17}[\dX]", code):
        return None
    try:
        day = datetime.date(int(code[6:10]), int(code[10:12]), int(code[12:14]))
    except ValueError:
        return None
    region = permuted_like(code[:6], key, "region", lambda x: "1" <= x[0] <= "8") if "1" <= code[0] <= "8" else code[:6]
    body = region + permuted_date(day, key).strftime("%Y%m%d") + permuted(code[14:17], key, "order")
    return body + (check_sign(body) if code[17] == check_sign(code[:17]) else code[17])


def spanish_number(code: str, key: bytes) -> str | None:
    """A DNI or NIE: the digits permuted, the first letter kept, the control letter made anew if it was right."""
    m = re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", code)
    if not m or len(code) != 9:
        return None
    letter = lambda d: SPANISH_LETTERS[int(str("XYZ".index(m[1])) + d if m[1] else d) % 23]
    new = permuted(m[2], key, "dni")
    return m[1] + new + (letter(new) if m[3] == letter(m[2]) else m[3])


def french_number(code: str, key: bytes) -> str | None:
    """A social security number: sex kept, month of birth permuted within a century, the rest permuted, the control key made anew if it was right."""
    m = re.fullmatch(r"([12378])(\d{2})(0[1-9]|1[0-2])(2[AB]|\d{2})(\d{6})(\d{2})", code)
    if not m:
        return None
    control = lambda body: 97 - int(body.replace("2A", "19").replace("2B", "18")) % 97
    month = permuted_range(int(m[2]) * 12 + int(m[3]) - 1, 1200, key, "nir month")
    if m[4].isdecimal():
        rest = permuted_like(m[4] + m[5], key, "nir", lambda x: "01" <= x[:2] <= "95") if "01" <= m[4] <= "95" else m[4] + permuted(m[5], key, "nir")
    else:
        rest = m[4] + permuted(m[5], key, "nir")
    body = f"{m[1]}{month // 12:02d}{month % 12 + 1:02d}{rest}"
    old = code[:5] + code[5:7] + code[7:13]
    return body + (f"{control(body):02d}" if int(m[6]) == control(old) else m[6])


def american_number(code: str, key: bytes) -> str | None:
    """A social security number: never with an area, group or serial that is not issued, if the value has none."""
    issued = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
    return permuted_like(code, key, "ssn", issued) if re.fullmatch(r"\d{9}", code) and issued(code) else None


def british_number(code: str, key: bytes) -> str | None:
    """A national insurance number: an issued prefix for an issued prefix, digits and suffix permuted."""
    m = re.fullmatch(r"([A-Z]{2})(\d{6})([A-D])", code)
    if not m or m[1] not in NINO_PREFIXES:
        return None
    prefix = NINO_PREFIXES[permuted_range(NINO_PREFIXES.index(m[1]), len(NINO_PREFIXES), key, "nino")]
    return prefix + permuted(m[2], key, "nino digits") + "ABCD"[permuted_range("ABCD".index(m[3]), 4, key, "nino suffix")]


def plain_code(code: str, key: bytes) -> str:
    """Any other code: digits permuted among the places of digits, letters among those of letters."""
    digits = permuted("".join(c for c in code if c.isdecimal()), key, "code digits")
    letters = [ord(c) - 65 for c in code if "A" <= c <= "Z"]
    number = 0
    for x in letters:
        number = number * 26 + x
    number = permuted_range(number, 26 ** len(letters), key, "code letters") if letters else 0
    for i in range(len(letters) - 1, -1, -1):
        number, letters[i] = divmod(number, 26)
    d, a = iter(digits), iter(letters)
    return "".join(next(d) if c.isdecimal() else chr(65 + next(a)) if "A" <= c <= "Z" else c for c in code)


def laid_out(value: str, signs: str) -> str:
    """``signs`` in the places of the letters and digits of ``value``; what stands between them, and small letters, stay."""
    new = iter(signs)
    return "".join((x.lower() if c.islower() else x) if (c.isdecimal() or c.isascii() and c.isalpha()) and (x := next(new, "")) else c for c in value)


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """A stand-in of the same format for numbers; a keyed code of 80 bits for everything else. Equal values, however written, get equal ones."""
    if kind == "phone":
        lead, number = phone_parts(value)
        shape = phone_shape(number)
        return laid_out(value, lead + permuted_like(number, key, "phone", lambda x: phone_shape(x) == shape))
    if kind == "identity":
        code = "".join(str(int(c)) if c.isdecimal() else c.upper() for c in value if c.isdecimal() or c.isascii() and c.isalpha())
        for known in (resident_number, spanish_number, french_number, american_number, british_number):
            if new := known(code, key):
                return laid_out(value, new)
        return laid_out(value, plain_code(code, key))
    plain = re.sub(r"[\W_]+", " ", value).strip().lower()
    if kind == "name":
        plain = " ".join(sorted(plain.split()))
    return hmac.digest(key, f"{kind}|{plain}".encode(), hashlib.sha256).hex()[:20]


def redacted(text: str, spans: list[tuple[int, int, str]], key: bytes) -> str:
    """The text with [type:pseudonym] in place of each mention; every other character is kept."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind}:{pseudonym(text[a:b], kind, key)}]"]
        at = b
    return "".join([*out, text[at:]])


# ---- Spark ----


def name_pairs(texts: DataFrame) -> DataFrame:
    """kind, a, b, n: neighbouring words that may be names, counted per batch before the shuffle."""
    han = re.compile(rf"({'|'.join(HAN_COMPOUND)}|[{HAN_SURNAMES}])([{HAN}]{{2}})(?=先生|女士|小姐)")
    latin = re.compile(r"(?<![\w’'-])([A-ZÀ-Ý][a-zß-ÿ]{2,}) ((?:[A-Za-z]['’])?[A-ZÀ-Ý][a-zß-ÿ]{2,}(?:-[A-ZÀ-Ý][a-zß-ÿ]+)?)(?![\w-])")
    titled = re.compile(rf"(?<![\w’'-])(?:{'|'.join(TITLES)})\.? ((?:[A-Za-z]['’])?[A-ZÀ-Ý][a-zß-ÿ]{{2,}}(?:-[A-ZÀ-Ý][a-zß-ÿ]+)?)(?![\w-])")

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if not text.isascii():
                    seen.update(("han", m[0], m[1]) for m in han.findall(text))
                seen.update(("pair", a.lower(), b.replace("’", "'").lower()) for a, b in latin.findall(text))
                seen.update(("title", "", x.replace("’", "'").lower()) for x in titled.findall(text))
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_pylist([dict(zip("kabn", r, strict=True)) for r in rows], schema=pa.schema([("k", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

    return texts.mapInArrow(count, "k string, a string, b string, n long").groupBy("k", "a", "b").agg(F.sum("n").alias("n"))


def learn_names(texts: DataFrame, given_names: DataFrame) -> DataFrame:
    """kind (given, family or han), word, n: the name lexicon of a corpus, stored.

    Family names follow a title, or a known given name; given names stand before
    three family names or more, and again. All counts are over all texts; names
    known to the office have n null.
    """
    pairs = stored(name_pairs(texts))
    known = given_names.where("given_name is not null").select(F.lower("given_name").alias("a")).distinct()
    titles = [t.lower() for t in TITLES]
    latin = pairs.where((F.col("k") == "pair") & ~F.col("a").isin(titles))
    seen = F.col("n") >= LEAST_SEEN
    titled = pairs.where("k = 'title'").groupBy("b").agg(F.sum("n").alias("n"))
    kin = latin.join(F.broadcast(known), "a", "left_semi").groupBy("b").agg(F.sum("n").alias("n"))
    family = titled.unionByName(kin).groupBy("b").agg(F.sum("n").alias("n")).where(seen).join(known.withColumnRenamed("a", "b"), "b", "left_anti")
    before = latin.join(family.select("b"), "b", "left_semi").groupBy("a").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    given = stored(before.where((F.col("kinds") >= 3) & seen).select("a", "n").unionByName(known.withColumn("n", F.lit(None).cast("long"))))
    behind = latin.join(given.select("a").distinct(), "a", "left_semi").groupBy("b").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") >= 3) & seen)
    family = family.unionByName(behind.select("b", "n")).join(known.withColumnRenamed("a", "b"), "b", "left_anti")
    han = pairs.where("k = 'han'").groupBy(F.col("b").alias("a")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") >= 2) & seen)
    is_han = F.col("a").rlike(r"^\p{IsHan}+$")
    parts = [(given.where(~is_han), "given"), (family.withColumnRenamed("b", "a"), "family"), (han.select("a", "n").unionByName(given.where(is_han)), "han")]
    rows = [d.select(F.lit(kind).alias("kind"), F.col("a").alias("word"), "n") for d, kind in parts]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind", "word").agg(F.max("n").alias("n"), F.max(F.col("n").isNull()).alias("office"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return stored(every.select("kind", "word", "n", (F.col("office") | (F.col("n") >= total * HOT_SHARE)).alias("hot")))


def rare_names(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds more (map from kind to names): the names outside the tasks' lexicon that a text holds; null if it holds none.

    Each text's distinct words meet the rare names in an equi-join.
    """
    cold = lexicon.where("not hot").select("kind", "word")
    if cold.isEmpty():
        return rows.withColumn("more", F.lit(None).cast("map<string,array<string>>"))
    low = F.translate(F.lower("text"), "’", "'")
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}+(?:[-']\p{L}+)*"), F.lit(0)))
    both = "|".join(HAN_COMPOUND)
    given = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(rf"(?=(?:{p})(\p{{IsHan}}{{2}}))"), F.lit(1)) for p in (both, f"[{HAN_SURNAMES}]")])))
    keys = ["source_table", "record_id"]
    asked = rows.where("text is not null").select(*keys, F.explode(F.array_union(words, given)).alias("word"))
    held = asked.join(cold, "word").groupBy(*keys, "kind").agg(F.collect_set("word").alias("words"))
    held = held.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("kind", "words"))).alias("more"))
    return rows.join(held, keys, "left")


def find_mentions(rows: DataFrame, given_names: DataFrame, key: bytes | None = None) -> DataFrame:
    """source_table, record_id, text, redacted, found (array of start_pos, end_pos, pii_type) of rows (source_table, record_id, text).

    One row per record (repeated deliveries of an id are one: the greatest of
    their texts). A null text stays null and has no mentions, an empty one is
    empty. Positions count code points. Without a key redacted is null: there is
    no pseudonym without a secret.
    """
    rows = stored(rows.groupBy("source_table", "record_id").agg(F.max("text").alias("text")))
    names = learn_names(rows.where(F.length("text") > 0).select("text"), given_names)
    hot = {k: set() for k in ("given", "family", "han")}
    for r in names.where("hot").collect():
        hot[r["kind"]].add(r["word"])
    lexicon = rows.sparkSession.sparkContext.broadcast(Lexicon(hot["given"], hot["family"], hot["han"]))
    kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("pii_type", pa.string())]))

    def work(batches):
        known = lexicon.value
        for batch in batches:
            texts, more = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            spans = [mentions(t, known.with_words(dict(m)) if m else known) if t else [] for t, m in zip(texts, more, strict=True)]
            new = [redacted(t, s, key) if s else t for t, s in zip(texts, spans, strict=True)] if key else [None] * len(texts)
            found = [[{"start_pos": a, "end_pos": b, "pii_type": k} for a, b, k in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string()), pa.array(found, kind)], names=["source_table", "record_id", "text", "redacted", "found"])

    asked = rare_names(rows, names).select("source_table", "record_id", "text", "more")
    return asked.mapInArrow(work, "source_table string, record_id string, text string, redacted string, found array<struct<start_pos:int,end_pos:int,pii_type:string>>")


def secret_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms, from KEY_SETTING. Without one pseudonyms are made with a key of their own that nobody keeps: linked within the result, and only there."""
    value = spark.conf.get(KEY_SETTING, None)
    return value.encode() if value else secrets.token_bytes(32)
