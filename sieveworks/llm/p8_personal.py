"""Personal details in free text: found, confirmed, scored and replaced."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chinese surnames, the first of the traditional list and some frequent ones, then surnames of two characters.
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常"
    "乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林钟徐邱骆高夏蔡田樊胡凌霍虞万柯管卢莫房丁邓洪包左石崔吉龚程邢裴陆荣翁段侯武刘景詹龙叶黎白廖易曾肖覃聂耿阎申关牛辛游温"
)
TWO_SURNAMES = ("欧阳", "司徒", "上官", "诸葛", "慕容", "司马", "夏侯", "皇甫", "尉迟", "公孙", "令狐", "宇文", "长孙", "轩辕", "东方", "南宫", "西门", "独孤", "端木", "百里")
# Digits as they may be written.
DIGIT_FORMS = {**{chr(0xFF10 + i): str(i) for i in range(10)}, **dict(zip("零一二三四五六七八九", "0123456789")), "〇": "0"}
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "account": "[ACCOUNT]"}

#: A span is reported from this score on.
ACCEPT = 1.0
#: Characters between two details that count as beside each other, and what that is worth.
BESIDE, BESIDE_WEIGHT = 3, 0.3
_HAN = r"[一-鿿]"
_DIGITS = str.maketrans(DIGIT_FORMS)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


# -- validators -------------------------------------------------------------------------------------------------------


def _date(text: str, pattern: str) -> bool:
    try:
        return datetime.datetime.strptime(text, pattern).year >= 1880
    except ValueError:
        return False


def resident_id(number: str) -> bool:
    """18 characters: a date of birth and a check character by ISO 7064 MOD 11-2; 15 digits: a date."""
    if re.fullmatch(r"\d{17}[\dX]", number):
        total = sum(int(d) * (2 ** (17 - i) % 11) for i, d in enumerate(number[:17]))
        return _date(number[6:14], "%Y%m%d") and "10X98765432"[total % 11] == number[17]
    return bool(re.fullmatch(r"\d{15}", number)) and _date("19" + number[6:12], "%Y%m%d")


def luhn(number: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(number))))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


# -- proposals --------------------------------------------------------------------------------------------------------

_AT = r"(?:@|＠|\s?\[\s?at\s?\]\s?|\s?\(\s?at\s?\)\s?|\s@\s|\s?（at）\s?|\s?#at#\s?)"
_DOT = r"(?:\.|．|\s?\[\s?dot\s?\]\s?|\s?\(\s?dot\s?\)\s?)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])", re.IGNORECASE)

_D = r"[0-9０-９]"
_SEP = r"[ \-.·]?"
_PHONES = (
    # mobile numbers of eleven digits, with or without the country's code
    (re.compile(rf"(?<![0-9０-９A-Za-z.\-+])(?:[(（]?\+?{_D}{{2}}[)）][ ]?|\+{_D}{{2}}[ \-]?)?[1１][3-9３-９]{_D}(?:{_SEP}{_D}{{4}}){{2}}(?![0-9０-９A-Za-z])(?!\.\d)"), 1.0),
    # the same in written-out digits
    (re.compile(r"(?<![〇零一二三四五六七八九])一[三四五六七八九][〇零一二三四五六七八九]{9}(?![〇零一二三四五六七八九])"), 1.0),
    # area code and number, which may also be other groups of digits: words or details beside it must speak for it
    (re.compile(rf"(?<![0-9０-９A-Za-z.\-+])(?:\+?86[ \-]?)?(?:[(（]0{_D}{{2,3}}[)）][ \-]?|0{_D}{{2,3}}[ \-]){_D}{{7,8}}(?![0-9０-９A-Za-z])"), 0.8),
    # North American numbers; three, three and four digits may be many things, so a word before them must speak for a number to call
    (re.compile(r"(?<![0-9A-Za-z.\-+(])(?:\+?1[ \-.])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ \-.])\d{3}[ \-.]\d{4}(?![0-9A-Za-z\-])"), 0.8),
    # other numbers with a country's code
    (re.compile(r"(?<![0-9A-Za-z])\+\d{1,3}(?:[ \-.]?\(?\d{2,5}\)?){2,4}(?![0-9A-Za-z])"), 0.8),
)
_IDS = (
    re.compile(rf"(?<![0-9０-９A-Za-z]){_D}{{6}}[ \-]?{_D}{{8}}[ \-]?{_D}{{3}}[0-9０-９XxＸ](?![0-9０-９A-Za-z])"),
    re.compile(rf"(?<![0-9０-９A-Za-z]){_D}{{15}}(?![0-9０-９A-Za-z])"),
)
_SSN = re.compile(r"(?<![0-9A-Za-z\-])\d{3}([- ])\d{2}\1\d{4}(?![0-9A-Za-z\-])")
_CARD = re.compile(r"(?<![0-9A-Za-z])\d{4}(?:[ -]?\d{4}){2,3}[ -]?\d{1,4}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")

# Chinese addresses are read from the left: places, then street or village, then numbers.
_P = rf"{_HAN}{{2,4}}?"
_NUM = rf"(?:{_D}+|[一二三四五六七八九十百]+)"
_TAIL = rf"(?:{_NUM}号楼{_NUM}单元{_NUM}室?|{_NUM}[栋幢]{_NUM}单元{_NUM}室?|{_NUM}号?[栋幢楼座]{_NUM}室?|{_HAN}{{2,4}}(?:花园|小区|公寓|苑|大厦|广场)?[A-Z]座{_NUM}层(?:{_NUM}室)?|院?{_NUM}-{_NUM}-{_NUM}|{_NUM}单元{_NUM}室?|{_NUM}室)"
_ROAD = rf"{_P}(?:里(?=[0-9０-９])|东路|西路|南路|北路|中路|东街|西街|南街|北街|支路|大道|大街|路|街|巷|胡同)"
_PLACES = rf"(?:{_P}(?:省|自治区))?(?:{_P}[市州])?(?:{_P}[区县旗])?"
_ADDRESS_CN = (
    re.compile(rf"{_PLACES}{_ROAD}{_NUM}(?:号院|号|弄{_NUM}号|弄)(?:{_TAIL})?"),
    re.compile(rf"{_PLACES}(?:{_P}[镇乡])?{_P}村(?:{_NUM}组)?{_NUM}号"),
    re.compile(rf"{_PLACES}(?:{_ROAD})?{_P}(?:小区|花园|公寓|家园|新村){_TAIL}"),
)
_ADDRESS_CUE = re.compile(
    r"(?:家庭住址|现住址|住址|地址|户籍|籍贯|居住地|现住在?|居住在|家住|住在|住于|住|寄到|寄往|送到|送往|送至|寄至|搬到|搬至|迁至|从|自|到|在|位于|于)[:：]?\s*$|[，,。；;：:（(\s、]$|^$"
)
_STREET_EN = r"(?:Road|Rd\.?|Street|St\.?|Lane|Ln\.?|Avenue|Ave\.?|Court|Ct\.?|Drive|Dr\.?|Way|Place|Close|Terrace|Boulevard|Blvd\.?)"
_ADDRESS_EN = re.compile(rf"(?<![0-9A-Za-z])\d{{1,5}}[A-Z]? (?:[A-Z][a-z]+ ){{1,3}}{_STREET_EN}(?![A-Za-z])(?:,? (?:Apt|Apartment|Flat|Unit|Suite|No)\.? ?#?\d+[A-Za-z]?)?")

# Names.
_CN_NAME = rf"(?:{'|'.join(TWO_SURNAMES)}|[{SURNAMES}])(?!某)[一-鿿](?:(?!某){_HAN})??"
_DOT_NAME = rf"{_HAN}{{2,5}}?[·•]{_HAN}{{2,6}}?(?:[·•]{_HAN}{{2,6}}?)?"
_EN_NAME = r"[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?(?: [A-Z]\.)?(?: (?:[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?)){1,2}"
_ONE = rf"(?:{_DOT_NAME}|{_CN_NAME}|{_EN_NAME})"
_LIST = rf"{_ONE}(?:[、和及与]{_ONE})*"
_ENDS = r"[，。；、：！？,;!?（(）)\s]|$"
_AFTER = rf"(?={_ENDS}|的|老师|先生|女士|同志|因|查房|护送|完成|负责|签收|整理|陪同|代|三日|次日|提交|来|自述|主诉|诉|称|要求|说|于|在)"
_NAME_CUES = (
    # a label or an introduction before the name
    (re.compile(rf"(?:我叫|名叫|姓名[:：为是]?|签名[:：]|签字[:：]|联系人[:：]?|收件人[:：]?|寄件人[:：]?|记录者[:：]?|记录人[:：]?|参加讨论[:：]|参加者[:：]|主管医师|主治医师|值班医师|责任护士|主刀|家属[:：]|患者姓名[:：]?)\s?({_LIST}){_AFTER}"), 3.0),
    # somebody does something
    (re.compile(rf"(?:由|经)\s?({_LIST})(?=老师|护送|完成|负责|签收|整理|陪同|代|记录|提交|出题|审核|接诊)"), 3.0),
    (re.compile(rf"(?:患者|病人|病患)\s?({_LIST})(?=因|于|自述|主诉|诉|的|要求|、|，[男女]|再次)"), 2.5),
    # at the beginning of a sentence, before what persons do or have
    (re.compile(rf"(?:^|[。！？；\n：:（(.!?]\s?)({_LIST})(?=的家属|的家人|[一二三四五六七八九十两\d]+日后|再次就诊|要求)", re.MULTILINE), 2.5),
    (re.compile(rf"(?:^|[。！？；\n：:（(.!?]\s?)({_ONE})(?=[，,]\s?(?:[(（+]|0\d|[1１][3-9３-９]|一[三四五六七八九][〇零一二三四五六七八九]))", re.MULTILINE), 2.5),
    # English
    (re.compile(rf"(?:Contact person:|[Ss]igned by|Dr\.|Mr\.|Mrs\.|Ms\.|Prof\.|[Nn]ame is|[Nn]ame:|[Nn]ext of kin:|[Aa]ccompanied by)\s?({_EN_NAME})(?![A-Za-z])"), 3.0),
    (re.compile(rf"(?:^|[。.!?\n：:]\s?|\s)({_EN_NAME})(?= (?:asked|reviewed|called|signed|said|reported|wrote|requested|told|noted|phoned|visited)\b)", re.MULTILINE), 2.5),
)
# Characters that given names are often made of.
GIVEN = frozenset(
    "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂文辉玲红建国华梅琴云莲真雪荣爱妹香月莺媛瑞凡佳嘉琼勤珍贞莉欣怡婷雅宁倩思晨宇浩然轩博俊豪鑫鹏飞龙斌波峰亮东海山仁志义兴良成康星光天达安岩中茂进林有坚和彪诚先敬震振壮会群"
    "心邦承乐绍功松善厚庆民友裕河哲江浦子佩琪雷晓春燕玉淑慧巧美惠珠翠芝萍芬彩菊凤洁琳素卿聪澜纯毓悦昭冰爽琬茗羽希育滢馥筠柔竹凝欢霄枫芸菲寒伊亚宜可姬舒影荔枝丹蓉眉君蕊薇菁梦岚苑婕馨瑗韵融园艺咏霭凌阳睿泽梓涵诗"
)
# Words that begin with a surname and go on like a given name but are none.
NO_NAMES = frozenset("安静 安宁 安康 安可 平安 平静 文静 方才 高兴 高龄 高飞 华东 明天 明月 黄山 金山 金星 江山 江海 江东 江心 白天 白云 白羽 白雪 和平 和善 康宁 成红 常会 常有 常可 单有 石英 马会 麻心 高达 任可 万有 于心 时有 时可 余有 温和 安平 卫东 莫中 顾心 何有 和中".split())
_GIVEN_NAME = rf"(?:(?:{'|'.join(TWO_SURNAMES)})|[{SURNAMES}])[{''.join(sorted(GIVEN))}]{{1,2}}"
_PERSON_BEFORE = r"(?:患者|病人|患儿|产妇|护士长|护士|医师|医生|主任|教授|同学|同事|邻居|联系|通知|致电|询问|告知|陪护|(?:[其她他][父母子女夫妻])|丈夫|妻子|儿子|女儿|父亲|母亲|家属)"
_PERSON_AFTER = (
    r"(?:先生|女士|小姐|同志|老师|医生|医师|护士|主任|教授|说|称|表示|告诉|自述|主诉|反映|补充|询问|今天|昨天|明天|今日|昨日|目前|现已|入院|出院|住院|就诊|来院|来诊|值班|查房|接诊|签字|陪同"
    r"|的(?:丈夫|妻子|父亲|母亲|儿子|女儿|家属|电话|手机|身份证|床位)|[（(](?:主任|护士|医生|医师|教授|患者|家属|本人|其))"
)
#: What speaks for a name that no cue above introduces: being one by its make, the words on either side, the bounds of a clause.
NAME_WEIGHTS = {"make": 0.4, "person_before": 0.7, "sentence_before": 0.3, "clause_before": 0.1, "person_after": 0.5, "clause_after": 0.2}
_MADE_NAME = re.compile(
    rf"(?:(?P<person>{_PERSON_BEFORE}[:：]?\s?)|(?P<sentence>(?:^|[。！？!?\n：:])\s?)|(?P<clause>[，,；;、（(]\s?))(?P<name>{_GIVEN_NAME}?)(?:(?P<after>(?={_PERSON_AFTER}))|(?P<end>(?=[，。；、！？,;!?（(）)\s]|$)))",
    re.MULTILINE,
)
_EN_STARTERS = frozenset("The If No Option Ward Please Trial Specimen Questions Picked Deliver See Call Contact Patient Doctor Tel Dr Mr Mrs Ms And But When".split())
_SPLIT = re.compile(r"[、和及与]")

# -- context ----------------------------------------------------------------------------------------------------------

#: Words before a span that make it something else, or make it surer.
_NEGATIVE = re.compile(
    r"(?:标本号|样本号|流水号|批准文号|条码|条形码|批号|登记号|试验号|编号|序列号|订单号|病案号|床号|内分机|分机|急救请拨|Specimen|Trial code|Lot|Accession|Barcode|Batch|extension|ext\.?)[:：为 #.]*(?:no\.?)?\s*$", re.IGNORECASE
)
_POSITIVE = {
    "phone": re.compile(r"(?:电话|手机|号码|联系方式|传真|座机|留了|留下|留的|Tel|Call|call|phone|Phone|微信|拨|desk is|致电|热线)[^0-9]{0,12}$"),
    "id_number": re.compile(r"(?:身份证|证件|社保|医保|ID|SSN|录入的是|提供了|insurer matched|（|\()[^0-9]{0,10}$"),
    "account": re.compile(r"(?:卡号|账号|帐号|银行卡|card|Card|account|IBAN)[^0-9A-Z]{0,10}$"),
}
_MASK = re.compile(r"[*＊Xx×●█]{3,}")


def _before(text: str, at: int, n: int = 18) -> str:
    return text[max(0, at - n) : at]


#: What every number has in it: so many digits, or written-out ones, close together, a country's code, or the head of an IBAN.
_DIGIT_ANCHOR = re.compile(r"\d[\d ().\-·（）]{5}|\+\d|[A-Z]{2}\d{2} ?[A-Z0-9]{4}|[〇零一二三四五六七八九]{9}")


def _numbers(text: str) -> list[Span]:
    found: list[Span] = []
    if not _DIGIT_ANCHOR.search(text):
        return found
    for pattern in _IDS:
        for m in pattern.finditer(text):
            plain = re.sub(r"[ \-]", "", m[0].translate(_DIGITS)).upper().replace("Ｘ", "X")
            before = _before(text, m.start())
            score = (1.5 if resident_id(plain) else -1.0) - (3.0 if _NEGATIVE.search(before) else 0.0) + (0.5 if _POSITIVE["id_number"].search(before) else 0.0)
            found.append(Span("id_number", *m.span(), score))
    for m in _SSN.finditer(text):
        before = _before(text, m.start())
        found.append(Span("id_number", *m.span(), 0.8 - (3.0 if _NEGATIVE.search(before) else 0.0) + (1.0 if _POSITIVE["id_number"].search(before) else 0.0)))
    for pattern, base in _PHONES:
        for m in pattern.finditer(text):
            before = _before(text, m.start())
            score = base - (3.0 if _NEGATIVE.search(before) else 0.0) + (1.0 if _POSITIVE["phone"].search(before) else 0.0)
            found.append(Span("phone", *m.span(), score))
    for pattern, valid in ((_CARD, luhn), (_IBAN, mod97)):
        for m in pattern.finditer(text):
            plain = re.sub(r"[ \-]", "", m[0])
            before = _before(text, m.start())
            if len(plain) >= 13 and _POSITIVE["account"].search(before) and valid(plain):
                found.append(Span("account", *m.span(), 2.0 - (3.0 if _NEGATIVE.search(before) else 0.0)))
    return found


#: What every Chinese address has in it; the slower expressions run only around such places.
_ADDRESS_ANCHOR = re.compile(r"[路街道巷里同村][0-9０-９一二三四五六七八九十百]|小区|花园|公寓|家园|新村")
#: Characters before such a place, and what follows it: so many characters that are no digits, with digits of any number between.
_BEFORE_ANCHOR, _AFTER_ANCHOR = 32, re.compile(r"(?:[0-9０-９一二三四五六七八九十百]*+[^0-9０-９一二三四五六七八九十百]){0,64}+[0-9０-９一二三四五六七八九十百]*+")


def _windows(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in _ADDRESS_ANCHOR.finditer(text):
        low, high = max(0, m.start() - _BEFORE_ANCHOR), _AFTER_ANCHOR.match(text, m.end()).end()
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _addresses(text: str) -> list[Span]:
    found = []
    for low, high in _windows(text):
        for pattern in _ADDRESS_CN:
            at = low
            while m := pattern.search(text, at, high):
                start = _place_start(text, *m.span(), pattern)
                if start is not None:
                    found.append(Span("address", start, m.end(), 1.5))
                at = m.end()
    return found + [Span("address", *m.span(), 1.5) for m in _ADDRESS_EN.finditer(text)]


def _place_start(text: str, start: int, end: int, pattern: re.Pattern[str]) -> int | None:
    """The first place from which the span still is an address, after a cue that introduces places.

    Place names have no marks of their own, so the words before an address may
    be taken for a part of its first name; a cue within the span ends them.
    """
    for at in range(max(0, start - 6), end):
        if _ADDRESS_CUE.search(text[max(0, at - 6) : at]) and (m := pattern.match(text, at)) and m.end() == end and not _ADDRESS_HEAD.match(text[at:end]):
            return at
    return None


#: What a place name doesn't begin with: the words that lead up to it.
_ADDRESS_HEAD = re.compile(r"(?:现住|家住|住在|住址|地址|居住|长期|患者|药品|寄到|寄往|送到|搬到|迁至|救护车|请|从|到|在|住|址|于|往|至|期|存|位于|病房)")


def _names(text: str, taken: list[Span]) -> list[Span]:
    found = []
    for pattern, score in _NAME_CUES:
        at = 0
        while m := pattern.search(text, at):
            place = m.start(1)
            for part in _SPLIT.split(m[1]):
                if part.split(" ")[0] not in _EN_STARTERS and not any(s.start < place + len(part) and place < s.end for s in taken):
                    found.append(Span("name", place, place + len(part), score - 1.0))
                place += len(part) + 1
            at = max(m.end(1), at + 1)
    return found + _names_by_make(text, taken + found)


def _names_by_make(text: str, taken: list[Span]) -> list[Span]:
    """Surname and given name as such, whose score comes from the context on both sides."""
    found = []
    w = NAME_WEIGHTS
    for m in _MADE_NAME.finditer(text):
        before = w["person_before"] if m["person"] is not None else w["sentence_before"] if m["sentence"] is not None else w["clause_before"]
        score = w["make"] + before + (w["person_after"] if m["after"] is not None else w["clause_after"])
        if m["name"] not in NO_NAMES and not any(s.start < m.end("name") and m.start("name") < s.end for s in taken):
            found.append(Span("name", *m.span("name"), round(score, 3)))
    return found


_RANK = {"email": 5, "id_number": 4, "account": 3, "phone": 3, "address": 2, "name": 1}


def personal_details(text: str | None) -> list[Span]:
    """Accepted spans in the order of the text; of overlapping ones the surer kind, then the longer stays."""
    if not text:
        return []
    sure = [Span("email", *m.span(), 2.0) for m in _EMAIL.finditer(text)]
    open_: list[Span] = []
    for s in _numbers(text) + _addresses(text):
        if not _MASK.search(text[s.start : s.end]):
            (sure if s.score >= ACCEPT else open_).append(s)
    sure += [s for s in _names(text, sure + open_) if s.score >= ACCEPT]
    # a number between a name and an address is that person's: details beside a span speak for it
    ends = [s for s in sure if s.kind in ("name", "address", "email", "phone")]
    for s in open_:
        beside = any(0 <= s.start - o.end <= BESIDE or 0 <= o.start - s.end <= BESIDE for o in ends)
        if beside and s.score + BESIDE_WEIGHT >= ACCEPT:
            sure.append(replace(s, score=s.score + BESIDE_WEIGHT))
    found = sure
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (-_RANK[s.kind], -(s.end - s.start), s.start)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def replaced(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s in personal_details(text):
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


_DETAILS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("found_text", T.StringType()), T.StructField("score", T.DoubleType())]))


@F.pandas_udf(_DETAILS)
def _details(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": s.kind, "found_text": t[s.start : s.end], "score": s.score} for s in personal_details(t)] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _replaced(texts: pd.Series) -> pd.Series:
    return pd.Series([replaced(t) for t in texts], dtype=object)


def find(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, found_text): each distinct detail of a document once.

    Expressions propose spans, validators confirm the numbers that carry a
    check (resident numbers by ISO 7064 MOD 11-2 and their date, cards by Luhn,
    IBANs by mod-97), and words before a span raise or lower its score. Null
    and empty texts have no details; texts of any length are read whole; other
    columns are not read. Rows are independent: the only shuffle removes
    repeats within a document.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.explode(_details(F.col(text))).alias("d"))
    return rows.select("id", "d.kind", "d.found_text").distinct()


def redacted(column: Column) -> Column:
    """The text with each detail replaced by a placeholder of its kind; null stays null."""
    return _replaced(column)
