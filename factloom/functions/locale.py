"""Word lists and patterns of a language, as data. Operators take a pack; none has words of its own."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pack:
    sentence_end: str  # a lookbehind for what ends a sentence
    include: str  # expressions that make a sentence worth checking
    counted: str  # those of them that count as a claim of their own
    extreme: str  # a historical extreme, which counts only where nothing else does
    durations: str  # at the start of what follows a number: group 1 makes it a length of time or an age
    age_range: str  # a range of ages, whose numbers are no values; may be empty
    junk: str  # where the trailing junk of a scraped article begins
    byline: str
    trailer: str  # where what follows an article for display begins
    widget: str  # text of embedded players
    dateline: str  # the line before an article's body; what stands before the last of them goes
    stops: tuple[str, ...]
    all_time: str
    n_years: str  # group 1: the number of years
    events: dict[str, int]  # an event that periods are counted from -> its year
    event_since: str  # group 1: the event
    max_words: str
    min_words: str
    foreign: tuple[str, ...]
    decrease: str
    increase: str
    comparison: str  # words by which a question asks for a comparison
    opinion: str  # words of enforcement or evaluation
    vocabulary: str  # words by which a reason speaks of statistics
    quarter_words: tuple[str, ...]
    month_words: tuple[str, ...]
    year_mark: str
    month_mark: str
    quarter_mark: str
    total_labels: tuple[str, ...] = ()
    operators: dict[str, str] = field(default_factory=dict)
    national: str = ""


#: White space as browsers know it, which article texts are shown by.
BLANK = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# The Korean words and patterns that results depend on.
_NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_SCALE = r"조|억|만|천"
_COMPOUND = rf"{_NUMBER}(?:{_SCALE})?(?:{_NUMBER}(?:{_SCALE})?)*"
_END = r"(?![\p{L}\p{N}_])"  # of a word, in any script
_AMOUNTS = rf"{_COMPOUND}\s*(?:원|달러|엔|유로|위안|명|건|개사|개|톤|t|kg|㎏|CGT|척)|{_NUMBER}\s*(?:%p|%|퍼센트포인트|퍼센트)"
_RUNS = rf"[0-9]+\s*(?:년째|개월째|주째)|[0-9]+\s*(?:년|개월)\s*연속|[0-9]+\s*위{_END}"
_PARTS = rf"(?:{_NUMBER}|한|두|세|네|다섯|여섯|일곱|여덟|아홉|열)\s*배|절반|[0-9]+\s*분의\s*[0-9]+|[0-9]+\.[0-9]+\s*(?:포인트|P{_END})|[0-9]+\.[0-9]+(?=[^0-9]{{0,6}}(?:기록했|기록되었|마감했|나타났|보였|집계됐|집계되었))"
_STAMP = rf"[0-9]{{4}}\.[0-9]{{2}}\.[0-9]{{2}}\.{BLANK}*[0-9]{{2}}:[0-9]{{2}}"
_EXTREME = r"역대\s*최(?:고|대|저)치?"
KOREAN = Pack(
    sentence_end=r"(?<=[다요]\.)",
    include=rf"{_AMOUNTS}|{_NUMBER}\s*점|{_RUNS}|{_EXTREME}|{_PARTS}",
    counted=rf"{_AMOUNTS}|{_RUNS}|{_PARTS}",
    extreme=_EXTREME,
    durations=r"^(개월|년|일|주|시간|분기|세)",
    age_range=r"\d+\s*[~\-]\s*\d+\s*세",
    junk="무단 전재|재배포 금지|관련기사",
    byline=r"[가-힣]{2,4}\s*기자",
    trailer="By Taboola",
    widget=r"(?s)Video Player is loading\..*?End of dialog window\.",
    dateline=rf"입력{BLANK}*{_STAMP}(?:{BLANK}*업데이트{BLANK}*{_STAMP})?(?:{BLANK}*[0-9]+)?",
    stops=("무단 전재", "재배포", "관련기사"),
    all_time="역대",
    n_years=r"(\d+)년\s*여?\s*만(?:에|의|이다|이었다)",
    events={"코로나": 2020, "코로나19": 2020, "팬데믹": 2020},
    event_since=r"(코로나(?:19)?|팬데믹)\s*이후",
    max_words="최고|최대|최다",
    min_words="최저|최소",
    foreign=("일본", "미국", "중국", "영국", "독일", "프랑스", "이탈리아", "러시아", "인도", "베트남", "캐나다", "호주", "브라질", "대만", "홍콩", "싱가포르", "인도네시아", "필리핀", "태국", "멕시코", "스페인", "네덜란드", "스위스", "사우디"),
    decrease="감소|하락|줄어|축소|내림|내렸|떨어|낮아|줄었|적자",
    increase="증가|상승|올랐|늘어|확대|늘었|높아|올림|흑자",
    comparison="증감|증가|감소|변화|대비|비교|보다|늘었|줄었|올랐|내렸|상승|하락|추이",
    opinion="단속|적발|평가",
    vocabulary="통계|조사|집계|지표|수치",
    quarter_words=("분기",),
    month_words=("월", "달"),
    year_mark="년",
    month_mark="월",
    quarter_mark="분기",
    total_labels=("계", "전체", "합계", "소계"),
    operators={"증가": "increase", "감소": "decrease", "상승": "increase", "하락": "decrease"},
    national="전국",
)

_ENGLISH_COUNTED = r"[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:percent|%|units|people|dollars|tons)|[0-9]+ (?:years|months) in a row|half|doubled"
#: The same for English news text.
ENGLISH = Pack(
    sentence_end=r"(?<=[.])",
    include=rf"{_ENGLISH_COUNTED}|record (?:high|low)",
    counted=_ENGLISH_COUNTED,
    extreme="record (?:high|low)",
    durations=r"^\s*(years|months)",
    age_range=r"\d+\s*[~\-]\s*\d+ years old",
    junk="All rights reserved|Related articles",
    byline=r"By [A-Z][a-z]+",
    trailer="All rights reserved|Related articles|By Taboola",
    widget=r"(?s)Video Player is loading\..*?End of dialog window\.",
    dateline=rf"Published{BLANK}*{_STAMP}(?:{BLANK}*Updated{BLANK}*{_STAMP})?(?:{BLANK}*[0-9]+)?",
    stops=("All rights reserved", "Related articles"),
    all_time="all-time|record",
    n_years=r"in (\d+) years",
    events={"pandemic": 2020},
    event_since=r"since the (pandemic)",
    max_words="highest|largest|most",
    min_words="lowest|smallest|least",
    foreign=("Japan", "China", "Germany", "France", "Italy", "Russia", "India", "Canada", "Brazil", "Mexico", "Spain"),
    decrease="fell|declined|dropped|decreased",
    increase="rose|grew|increased|gained",
    comparison="rose|grew|increased|gained|fell|declined|dropped|decreased",
    opinion="crackdown|assessment",
    vocabulary="statistic|survey|figure|index",
    quarter_words=("quarter",),
    month_words=("month",),
    year_mark="y",
    month_mark="m",
    quarter_mark="q",
    total_labels=("total", "all"),
    operators={"rise": "increase", "increase": "increase", "fall": "decrease", "decrease": "decrease"},
    national="nationwide",
)
