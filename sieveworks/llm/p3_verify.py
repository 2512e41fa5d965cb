"""Whether two questions in canonical form are the same question."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import cached_property

# Wordings of exam questions that mean the same; the right form stands for the left one.
SAME_WORDING = {
    "病人": "患者", "发生": "出现", "伴有": "合并", "叙述": "说法", "描述": "说法", "合适": "恰当",
    "体格检查": "查体", "实验室检查": "化验", "化验检查": "化验", "属于": "是", "处置": "处理",
    "显示": "示", "提示": "示", "此类": "该类", "此例": "该例", "以下": "下列", "再次": "复", "入组": "纳入",
    "的患者": "者", "临床上": "", "临床": "", "治疗效果": "疗效", "采用": "采取", "服用": "用", "使用": "用",
}
# Labels put before a question.
LABELS = ("例题", "练习", "练习题", "案例分析", "请选择", "模拟题", "单元测验", "真题", "单选", "多选", "单选题", "多选题", "病例分析", "思考题", "测验", "习题")
# Pairs that turn a question into its opposite.
OPPOSITES = (
    ("正确", "错误"), ("禁忌", "适应"), ("主", "次"), ("优先", "避免"), ("禁用", "首选"), ("无", "有"), ("大", "小"), ("早", "晚"),
    ("多", "少"), ("高", "低"), ("增", "减"), ("升", "降"), ("上", "下"), ("左", "右"), ("内", "外"), ("前", "后"), ("阳", "阴"),
    ("男", "女"), ("快", "慢"), ("急", "慢"), ("强", "弱"), ("最不", "最"), ("应", "不"), ("宜", "忌"), ("支持", "反对"), ("加重", "缓解"),
    ("符合", "违背"), ("包括", "除外"), ("轻", "重"), ("长", "短"), ("首", "末"), ("冷", "热"),
)
# Syllables of drug names in Chinese.
DRUG_SYLLABLES = frozenset(
    "阿艾奥巴贝倍苯泊布单达丁多伐芬酚孚氟非格胺环己吉卡克拉来兰劳利林列罗洛隆氯麦霉美米莫尼诺帕哌培喷匹普齐曲瑞萨赛塞沙舍司他它坦汀替酮妥韦维沃西昔硝辛雅依伊乙扎唑佐酯丙甲"
)
#: Equal characters at which two texts are taken apart, and those kept on either side.
APART, CONTEXT = 48, 16
#: Characters left out and put in of two texts that may differ by slips only: no more than twice ``most`` + 4, for the greatest ``most``.
MOST_EDITS = 24
NEGATIONS = "不未无勿"
#: Words that may stand before or after an option without changing it.
SOFT_BEFORE, SOFT_AFTER = ("可考虑", "考虑", "可", "宜"), ("为宜", "等", "者")

_FIGURES = re.compile(r"[0-9]+(?:[.:][0-9]+)*|[-+%/×÷<>=~±≤≥≠≈]|[⁺⁻⁰¹²³⁴-⁹₀-₉]+|[一二三四五六七八九十]+(?=[度级期型号类])")


@dataclass(frozen=True)
class Wording:
    """What is light rewording, and what changes a question, in the language of the questions; all of it may be replaced."""

    same: Mapping[str, str] = field(default_factory=lambda: SAME_WORDING)
    labels: Sequence[str] = LABELS
    opposites: Sequence[tuple[str, str]] = OPPOSITES
    name_syllables: frozenset[str] = DRUG_SYLLABLES
    negations: str = NEGATIONS
    soft_before: Sequence[str] = SOFT_BEFORE
    soft_after: Sequence[str] = SOFT_AFTER

    @staticmethod
    def _any(words: Iterable[str]) -> str:
        return "|".join(sorted(map(re.escape, words), key=len, reverse=True)) or "(?!)"

    @cached_property
    def _patterns(self) -> tuple[re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
        soft = f"^(?:{self._any(self.soft_before)})+|(?:{self._any(self.soft_after)})+$"
        return re.compile(self._any(self.same)), re.compile(f"^(?:{self._any(self.labels)})+"), re.compile(soft)

    def unlabelled(self, question: str) -> str:
        return self._patterns[1].sub("", question)

    def reworded(self, question: str) -> str:
        return self._patterns[0].sub(lambda m: self.same[m[0]], self.unlabelled(question))

    def bare_option(self, option: str) -> str:
        return self._patterns[2].sub("", option)


MEDICAL_EXAM = Wording()


def figures(text: str) -> tuple[str, ...]:
    """Numbers and signs in their order; two texts that differ in them are not the same."""
    return tuple(_FIGURES.findall(text))


def _edits(a: str, b: str) -> list[tuple[str, str, int]]:
    """(left out, put in, place) for each difference, for texts of any length in time in proportion to it.

    Equal ends are cut off, then texts are taken apart at the long equal runs of
    a shortest edit script and the short pieces between are aligned. Texts
    without a script of ``MOST_EDITS`` are one difference: every other way to
    align them has as many edits or more, so that is too large for slips.
    """
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        return [(x, y, head)] if x or y else []
    runs = _equal_runs(x, y)
    if runs is None:
        return [(x, y, head)]
    out, i, j = [], 0, 0
    for at_x, at_y, k in [*(r for r in runs if r[2] >= APART), (len(x), len(y), 0)]:
        end_x, end_y = at_x + min(k, CONTEXT), at_y + min(k, CONTEXT)
        pieces = SequenceMatcher(None, x[i:end_x], y[j:end_y], autojunk=False).get_opcodes()
        out += [(x[i + i1 : i + i2], y[j + j1 : j + j2], head + i + i1) for tag, i1, i2, j1, j2 in pieces if tag != "equal"]
        i, j = at_x + max(k - CONTEXT, 0), at_y + max(k - CONTEXT, 0)
    return out


def _equal_runs(x: str, y: str) -> list[tuple[int, int, int]] | None:
    """(place in x, place in y, length) of the equal runs of a shortest edit script (Myers), or None from ``MOST_EDITS`` + 1 edits on.

    Takes time in proportion to the lengths, as no more than 2 * ``MOST_EDITS`` + 1 diagonals are followed.
    """

    def agree(i: int, j: int) -> int:
        n, step = 0, 256
        while step:
            while i + n + step <= len(x) and j + n + step <= len(y) and x[i + n : i + n + step] == y[j + n : j + n + step]:
                n += step
            step //= 2
        return n

    reached, trail = {1: 0}, []
    for d in range(MOST_EDITS + 1):
        trail.append(dict(reached))
        for k in range(-d, d + 1, 2):
            i = reached[k + 1] if k == -d or (k != d and reached[k - 1] < reached[k + 1]) else reached[k - 1] + 1
            reached[k] = i = i + agree(i, i - k) if i <= len(x) and i - k <= len(y) else i
            if i == len(x) and i - k == len(y):
                return _traced(trail, i, k)
    return None


def _traced(trail: list[dict[int, int]], i: int, k: int) -> list[tuple[int, int, int]]:
    runs = []
    for d in range(len(trail) - 1, -1, -1):
        before = trail[d]
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        start = before[k + 1] if down else before[k - 1] + 1
        runs.append((start, start - k, i - start))
        k, i = (k + 1, start) if down else (k - 1, start - 1)
    return runs[::-1]


def _slips_only(a: str, b: str, most: int, w: Wording) -> bool:
    """a and b differ only by slips of the pen: single characters left out, doubled, swapped or mistaken."""
    if a == b:
        return True
    if any(a.count(c) != b.count(c) for c in w.negations):
        return False
    x, y = Counter(a), Counter(b)
    if (x - y).total() > most + 4 or (y - x).total() > most + 4:
        return False  # what stands on one side only is in the edits, however texts are aligned
    edits = _edits(a, b)
    left = "".join(x for x, _, _ in edits)
    right = "".join(y for _, y, _ in edits)
    if len(edits) > most or sum(max(len(x), len(y)) for x, y, _ in edits) > most + 4:
        return False
    for x, y in w.opposites:
        if (x in left and y in right and x not in right and y not in left) or (y in left and x in right and y not in right and x not in left):
            return False
    # what stands on both sides was only moved; a name replaced leaves different syllables on either side
    gone, come = [c for c in left if c not in right], [c for c in right if c not in left]
    drug_gone, drug_come = sum(c in w.name_syllables for c in gone), sum(c in w.name_syllables for c in come)
    if drug_gone and drug_come:
        return False
    swapped = sum(min(len(x), len(y)) for x, y, _ in edits if x and y and sorted(x) != sorted(y))
    return swapped <= 2 and all(max(len(x), len(y)) <= (3 if x and y else 5) for x, y, at in edits if at)


def same_option(a: str, b: str, w: Wording = MEDICAL_EXAM) -> bool:
    x, y = w.bare_option(a), w.bare_option(b)
    return x == y or (figures(a) == figures(b) and min(len(x), len(y)) > 3 and abs(len(x) - len(y)) <= 2 and _slips_only(x, y, 2, w))


def same_options(a: list[str], b: list[str], w: Wording = MEDICAL_EXAM) -> bool:
    """Each option of a has its own partner in b, whatever their letters."""
    if len(a) != len(b):
        return False
    left, right = list(a), list(b)
    for same in (lambda x, y: x == y, lambda x, y: same_option(x, y, w)):
        for x in list(left):
            hit = next((i for i, y in enumerate(right) if same(x, y)), None)
            if hit is not None:
                left.remove(x)
                right.pop(hit)
    return not left


def same_question(a: str, options_a: list[str], b: str, options_b: list[str], w: Wording = MEDICAL_EXAM) -> bool:
    """The same question with the same options, up to slips, light rewording, labels and re-lettered options."""
    x, y = w.unlabelled(a), w.unlabelled(b)
    if figures(x) != figures(y) or not same_options(options_a, options_b, w):
        return False
    # a slip within a wording hides it from one of the two forms, so both are tried
    return _slips_only(w.reworded(a), w.reworded(b), 8, w) or _slips_only(x, y, 8, w)
