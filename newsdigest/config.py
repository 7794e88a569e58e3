"""Run configuration and the fixed values the digest semantics depend on.

Everything that changes behaviour lives in :class:`Config`; every operator takes
the config (or one of its fields) as a parameter, so a Latin-alphabet profile for
the driver tables and the original Cyrillic profile share one code path.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the monitored job's values for equal results;
# they are stated here plainly, in their natural order.
# ---------------------------------------------------------------------------

#: scoring thresholds: v1 on the raw probability, v2 after rounding to 3 decimals
THRESHOLD_V1 = 0.126590649344836
THRESHOLD_V2 = 0.2792921738167593
#: scoring batch size (texts per batch)
BATCH_SIZE = 50
#: cosine similarity above which two texts are duplicates (live value / library default)
KSIM_LIVE = 0.8
KSIM_DEFAULT = 0.95

#: entity placeholders, by entity type
ENTITY_PLACEHOLDERS = {"ORG": " _орг ", "PER": " _пер ", "LOC": " _лок "}
NUMBER_PLACEHOLDER = " _чсл "
DATE_PLACEHOLDER = " _дат "

#: number words masked by the extra cleaning step
NUMBER_WORDS = [
    "ноль", "нуль", "один", "два", "три", "четыре", "пять",
    "шесть", "семь", "восемь", "девять", "десять",
    "одиннадцать", "двенадцать", "тринадцать", "четырнадцать",
    "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать",
    "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят",
    "семьдесят", "восемьдесят", "девяносто",
    "сто", "двести", "триста", "четыреста", "пятьсот",
    "шестьсот", "семьсот", "восемьсот", "девятьсот",
    "тысяча", "миллион", "миллиард", "триллион",
    "полтысяча", "полмиллиона", "полмиллиард", "полумиллиард", "полмиллиарда",
    "полутриллион", "полтриллиона", "млрд", "млд", "млн",
]

#: calendar words masked by the extra cleaning step
DATE_WORDS = [
    "декабрь", "январь", "февраль", "март", "апрель", "май",
    "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь",
    "понедельник", "вторник", "среда", "четверг", "пятница", "суббота", "воскресение",
]

#: collective nouns for the plural/collective flag
COLLECTIVE_WORDS = ["коллектив", "отдел", "экипаж", "группа",
                    "подразделение", "отделение", "забастовка", "митинг"]

#: negation particle glued to the next token; it survives stop words and the length filter
NEGATION_WORD = "не"

#: letters kept by the alphabet filter (as a regex class body)
ALPHABET = "а-я"

#: month stems mapped to English names before free-form date parsing (the key 'маЙ'
#: has a capital letter and never matches lowered input; see Config.fix_may_stem)
MONTH_STEMS = [
    ("январ", "january"),
    ("феврал", "february"),
    ("март", "march"),
    ("апрел", "april"),
    ("маЙ", "may"),
    ("мая", "may"),
    ("июн", "june"),
    ("июл", "july"),
    ("август", "august"),
    ("сентябр", "september"),
    ("октябр", "october"),
    ("ноябр", "november"),
    ("декабр", "december"),
]

#: sentences removed from every resolved article text
BOILERPLATE = [
    "Если ваши трудовые права нарушены, вы можете обратиться в государственную инспекцию труда, "
    "в том числе дистанционно через сервис \"Сообщить о проблеме\" на портале \"Онлайнинспекция.рф\"",
    "Подписывайтесь на нас в",
]

#: label stripped from source links
SOURCE_LABEL = "Источник:"
#: web archive prefix removed before the host lookup
ARCHIVE_PREFIX = "https://web.archive.org/web/"

#: social network host whose reposts are removed, and the wall URL prefix of a post id
REPOST_HOST = "vk.com"
REPOST_WALL_PREFIX = "https://vk.com/wall"
#: repost marker; the captured group is the reposted post id (greedy prefix: the last id wins)
REPOST_PATTERN = r'.*Reposted \(.*data-post-id="(.*?)".*'
#: author link class and the author whose posts are skipped
AUTHOR_LINK_CLASS = "pi_author"
SKIPPED_AUTHOR = "ЗабастКом"

#: messenger host, and the public-preview path rewrite applied to its links
MESSENGER_HOST = "t.me"
MESSENGER_FIX = ("://t.me/", "://t.me/s/")
#: messenger post markup: two message class variants and the text class variants
MESSENGER_MESSAGE_CLASSES = [
    "tgme_widget_message js-widget_message",
    "tgme_widget_message text_not_supported_wrap js-widget_message",
]
MESSENGER_TEXT_CLASSES = [
    "tgme_widget_message_text js-message_text",
    "tgme_widget_message_text js-message_text before_footer",
]

#: feed aggregator whose item links are taken from the description
FEED_AGGREGATOR = "bezformata"

#: hosts fetched politely (kept for completeness of the captures model)
POLITE_HOSTS = ["vk.com"]

#: tags whose text the sub-tag walk collects, in walk order
SUBTAG_KEYS = ["h1", "h2", "h3", "h4", "h5", "p", "li"]

#: daily report strings
REPORT_DATE_HEADER = "Дата"
REPORT_TITLE_HEADER = "Текстовка"
REPORT_LINK_HEADER = "Ссылка"
REPORT_NOTHING_FOUND = "Ничего не найдено"
REPORT_HEAD = ('<head><link rel="stylesheet" href="page.css" type="text/css">'
               '<meta http-equiv="Content-Type" content="text/html;charset=utf-8"></head>')
REPORT_TIME_FORMAT = "dd-MM-yyyy HH:mm"
REPORT_TABLE_END = "</table>"

#: hosts whose first rule selector takes the article's path in an attribute
PATH_ATTRIBUTES = {"vz.ru": "data-url"}

#: digest strings
DIGEST_SINGLES_HEADER = "News without duplicates:"
DIGEST_GROUPS_HEADER = "News with duplicates:"
DIGEST_SEPARATOR = "-" * 30

#: history file date format
HISTORY_DATE_FORMAT = "dd/MM/yyyy"


@dataclass(frozen=True)
class Config:
    """Parameters of one run. Defaults are the monitored job's values."""

    run_ts: _dt.datetime = field(default_factory=lambda: _dt.datetime(2024, 1, 15, 12, 0, 0))
    filter_by_keywords: bool = True
    batch_size: int = BATCH_SIZE
    threshold_v1: float = THRESHOLD_V1
    threshold_v2: float = THRESHOLD_V2
    ksim: float = KSIM_LIVE
    head_paragraphs: int = 4
    alphabet: str = ALPHABET
    negation: str = NEGATION_WORD
    number_words: tuple = tuple(NUMBER_WORDS)
    date_words: tuple = tuple(DATE_WORDS)
    collective_words: tuple = tuple(COLLECTIVE_WORDS)
    placeholders: dict = field(default_factory=lambda: {
        "ORG": ENTITY_PLACEHOLDERS["ORG"].strip(),
        "PER": ENTITY_PLACEHOLDERS["PER"].strip(),
        "LOC": ENTITY_PLACEHOLDERS["LOC"].strip(),
        "NUM": NUMBER_PLACEHOLDER.strip(),
        "DAT": DATE_PLACEHOLDER.strip(),
    })
    boilerplate: tuple = tuple(BOILERPLATE)
    #: Q14: all zero-vector texts in one group (True) or each its own singleton (False)
    zero_vectors_one_group: bool = False
    #: Q3: dotted dates day-first
    dayfirst: bool = False
    #: Q4: also map the lower-case May stem
    fix_may_stem: bool = True
    #: when a dictionary DataFrame has at most this many rows it is inlined as a map literal
    inline_dict_max_rows: int = 100_000

    @property
    def run_day(self) -> _dt.date:
        return self.run_ts.date()

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


# ---------------------------------------------------------------------------
# The profile used with the driver's synthetic tables (Latin alphabets). It is a
# test parameter set, not a reference value.
# ---------------------------------------------------------------------------

LATIN_ALPHABET = "a-zà-ÿ"
LATIN_NEGATION = "no"
LATIN_NUMBER_WORDS = ("un", "une", "ein", "eine", "uno", "dos", "one", "two", "three", "deux", "zwei")
LATIN_DATE_WORDS = ("monday", "lundi", "january", "mai", "may")
LATIN_COLLECTIVE_WORDS = ("group", "team", "union", "worthless")
LATIN_STOPWORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was",
                   "with", "be", "as", "by", "de", "la", "der", "en", "que", "le", "des", "die",
                   "und", "et", "les", "el", "los", "no")
LATIN_LEMMAS = (("was", "be"), ("are", "be"), ("this", "that"), ("from", "fro"),
                ("orre", "orr"), ("rewh", "rew"), ("thatin", "that"))
LATIN_ENTITIES = (("hehely", "ORG"), ("inoran", "PER"), ("orantion", "LOC"), ("worthless", "ORG"))
LATIN_NAMES = (("hehely", "ORG"), ("hehely hehely", "PER"), ("of the", "LOC"), ("the and", "ORG"), ("the the the", "PER"),
               ("de de", "LOC"), ("the of the and", "ORG"))
LATIN_KEYWORDS = ("worthless", "", "  Nicht ", "hehely", "\t")
LATIN_BOILERPLATE = ("Eauouon.", "Is and retitioning ouen the of, nterti thorreou ndernt.")


def latin_config(**kw) -> Config:
    """The Latin profile for the driver tables (run day 2024-01-15)."""
    base = Config(
        alphabet=LATIN_ALPHABET,
        negation=LATIN_NEGATION,
        number_words=LATIN_NUMBER_WORDS,
        date_words=LATIN_DATE_WORDS,
        collective_words=LATIN_COLLECTIVE_WORDS,
        placeholders={"ORG": "_org", "PER": "_per", "LOC": "_loc", "NUM": "_num", "DAT": "_dat"},
        boilerplate=LATIN_BOILERPLATE,
    )
    return base.with_(**kw) if kw else base
