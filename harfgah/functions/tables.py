"""Fixed values of the conversion: correspondences, word lists, endings. Data only."""

from __future__ import annotations

from functools import cache

# Persian letter or letters, Latin spellings from the commonest, where in a word it may stand, weight.
ANYWHERE = ("initial", "medial", "final")
INNER = ("medial", "final")
CORRESPONDENCES: list[tuple[str, tuple[str, ...], tuple[str, ...], str, float]] = [
    ("ب", ("b",), ANYWHERE, "consonant", 100),
    ("پ", ("p",), ANYWHERE, "consonant", 60),
    ("ت", ("t",), ANYWHERE, "consonant", 100),
    ("ط", ("t",), ANYWHERE, "consonant", 12),
    ("ث", ("s",), ANYWHERE, "consonant", 3),
    ("ج", ("j",), ANYWHERE, "consonant", 60),
    ("چ", ("ch",), ANYWHERE, "consonant", 35),
    ("ح", ("h",), ANYWHERE, "consonant", 18),
    ("ه", ("h",), ANYWHERE, "consonant", 100),
    ("خ", ("kh", "x"), ANYWHERE, "consonant", 70),
    ("د", ("d",), ANYWHERE, "consonant", 100),
    ("ذ", ("z",), ANYWHERE, "consonant", 4),
    ("ر", ("r",), ANYWHERE, "consonant", 100),
    ("ز", ("z",), ANYWHERE, "consonant", 70),
    ("ض", ("z",), ANYWHERE, "consonant", 5),
    ("ظ", ("z",), ANYWHERE, "consonant", 3),
    ("ژ", ("zh", "j"), ANYWHERE, "consonant", 6),
    ("س", ("s",), ANYWHERE, "consonant", 100),
    ("ص", ("s",), ANYWHERE, "consonant", 12),
    ("ش", ("sh",), ANYWHERE, "consonant", 70),
    ("غ", ("gh", "q"), ANYWHERE, "consonant", 20),
    ("ق", ("gh", "q"), ANYWHERE, "consonant", 40),
    ("ف", ("f",), ANYWHERE, "consonant", 80),
    ("ک", ("k", "c"), ANYWHERE, "consonant", 100),
    ("گ", ("g",), ANYWHERE, "consonant", 60),
    ("ل", ("l",), ANYWHERE, "consonant", 90),
    ("م", ("m",), ANYWHERE, "consonant", 100),
    ("ن", ("n",), ANYWHERE, "consonant", 100),
    ("و", ("v", "w"), ANYWHERE, "consonant", 90),
    ("ی", ("y",), ANYWHERE, "consonant", 100),
    ("آ", ("aa", "a", "â"), ("initial",), "vowel", 60),
    ("ا", ("aa", "a", "â"), INNER, "vowel", 100),
    ("ا", ("a", "e", "o"), ("initial",), "carrier", 100),
    ("", ("a", "e", "o"), INNER, "carrier", 150),
    ("و", ("oo", "u", "ou", "o"), INNER, "vowel", 80),
    ("او", ("oo", "u", "ou"), ("initial",), "vowel", 25),
    ("ی", ("i", "ee", "y"), INNER, "vowel", 90),
    ("ای", ("i", "ee"), ("initial",), "vowel", 25),
    ("ی", ("ey", "ei", "ay", "ai"), INNER, "diphthong", 20),
    ("ای", ("ey", "ei"), ("initial",), "diphthong", 10),
    ("و", ("ow", "au"), INNER, "diphthong", 10),
    ("او", ("ow",), ("initial",), "diphthong", 5),
    ("ه", ("e", "eh", "a", "ah"), ("final",), "silent", 90),
    ("ع", ("", "'", "a", "e", "o"), ANYWHERE, "silent", 55),
    ("ء", ("", "'"), ANYWHERE, "silent", 5),
    ("ئ", ("", "'", "y", "i"), ANYWHERE, "silent", 8),
    ("ؤ", ("", "'", "v"), ANYWHERE, "silent", 2),
    ("و", ("",), ANYWHERE, "silent", 6),
    ("‌", ("", " ", "-"), ANYWHERE, "zwnj", 40),
    ("ی", ("iy",), INNER, "variant", 90),
    ("خو", ("kh",), ANYWHERE, "variant", 6),
    ("سی", ("ci", "cy"), ANYWHERE, "variant", 2),
    ("یی", ("i", "ei"), ("final",), "variant", 5),
]

# Words that are English whatever they look like.
ENGLISH = frozenset(
    """the for are but not you all any can had her was one our out day get has him his how its may new now old see two who boy did she use way she
    about after again below could every first found great house large learn never other place right small sound still such their there these thing think three under water where which world would write years young
    because before between both during through while against always another around behind during either enough however maybe might must myself nothing perhaps really should something sometimes though together whether without
    please thanks thank sorry hello goodbye yes okay
    email inbox password username login logout signup signin account settings profile search upload download delete update install uninstall
    file folder client browser network database query cache token session cookie
    google apple microsoft amazon netflix spotify youtube twitter facebook instagram telegram whatsapp linkedin github gitlab discord reddit tiktok
    iphone android windows linux macos ubuntu chrome firefox safari edge
    react vue angular svelte node deno typescript javascript python rust golang swift kotlin java
    startup meeting deadline project manager engineer designer developer product feature release version build deploy
    monday tuesday wednesday thursday friday saturday sunday
    january february march april june july august september october november december
    airport flight ticket booking restaurant coffee pizza burger
    madrid rome sydney toronto dubai doha muscat kuwait riyadh istanbul moscow beijing
    england france germany spain italy australia europe africa
    university college school student teacher professor library hospital patient
    money price discount payment invoice receipt shipping delivery
    music video photo camera screen keyboard mouse phone laptop tablet charger""".split()
)
# Latin-typed Persian words that look English, or are names.
HOMOGRAPHS = frozenset(
    """man to in az ba be bar bad bood bud sad sar shod shab shom chap chera chi che chand and
    dar dard dast dust doost darad daram dare del dige digar
    goft gol gom gah haft hal ham hame har hast hich
    in un on az ke ki key kar kam kard konam koja
    mah man mard mara mese mikonam miram mishe nan nane nist no nou nam name
    pas par por pol pir ran rah raft ro roo roz sang sib sobh
    tan tar tor tou tu ta tak tang toop
    yek yad zan zir zood
    ast are ara ali amir arash reza sara sina mina nima mani rami
    tehran esfahan isfahan shiraz mashhad tabriz ahvaz karaj qom rasht yazd kerman urmia zahedan
    iran irani tehrani farsi persia alborz damavand zagros caspian
    hafez saadi ferdowsi rumi molana khayyam sohrab forough""".split()
)
ENGLISH_SUFFIXES = ("tion", "sion", "ment", "ness", "ship", "able", "ible", "ing", "ely", "ity", "ous", "ful", "ize", "ise")
ENGLISH_CLUSTERS = ("th", "wh", "ck", "ph", "qu", "wr", "kn", "oa", "ea", "ue", "ay", "ow")

# Endings of loanwords.
PLURAL = {"a": "ا", "ha": "ها"}
POSSESSIVE_AFTER_CONSONANT = {"am": "م", "at": "ت", "et": "ت", "ash": "ش", "esh": "ش", "amun": "مون", "emun": "مون", "atun": "تون", "etun": "تون", "ashun": "شون", "eshun": "شون", "amoon": "مون", "emoon": "مون", "atoon": "تون", "etoon": "تون", "ashoon": "شون", "eshoon": "شون"}
POSSESSIVE_AFTER_VOWEL = {"m": "م", "t": "ت", "sh": "ش", "mun": "مون", "tun": "تون", "shun": "شون", "moon": "مون", "toon": "تون", "shoon": "شون"}

# Affixes of Latin-typed words; the last but two is the unwritten linking vowel.
PREFIXES = [("nemi", "نمی"), ("mi", "می"), ("be", "ب"), ("bo", "ب"), ("na", "ن"), ("ne", "ن")]
LINK = "<link>"
SUFFIXES = [
    ("ro", "رو"), ("roo", "رو"), ("raa", "را"), ("ra", "را"), ("o", "و"), ("haa", "ها"), ("ha", "ها"), ("am", "م"), ("at", "ت"), ("et", "ت"), ("ash", "ش"), ("esh", "ش"),
    ("emoon", "مون"), ("emun", "مون"), ("amoon", "مون"), ("emaan", "مان"), ("eman", "مان"), ("etoon", "تون"), ("etun", "تون"), ("etaan", "تان"), ("etan", "تان"),
    ("eshoon", "شون"), ("eshun", "شون"), ("eshaan", "شان"), ("eshan", "شان"), ("moon", "مون"), ("toon", "تون"), ("shoon", "شون"), ("i", "ی"), ("ye", LINK), ("tarin", "ترین"), ("tar", "تر"),
]
MIN_STEM = 3

# Fixed values of the metrics.
SPLIT_MARKS = ".,!?;:()[]{}\"'-،؛؟«»—–…"
JOINING_PREFIXES = ("می", "نمی")
JOINING_SUFFIXES = ("ها", "های", "ای", "ام", "ایم", "اید", "اند", "تر", "ترین")

# Fixed values of the sentence passes.
WORD_EXCEPTIONS = {"na": "نه", "baad": "بعد", "hata": "حتی", "hatta": "حتی", "hataa": "حتی"}
EZAFE_HEADS = ("بخاطر", "زیر", "داخل", "کنار", "وسط", "بیرون", "پشت", "بعد", "قبل", "بین", "مثل", "بدون", "طرف", "سمت", "دنبال", "پایین", "مقابل")
SUFFIX_AFTER_HE = {"i": "ای", "ei": "ای", "ii": "ای", "ee": "ای", "ie": "ای", "and": "اند", "am": "ام", "im": "ایم", "id": "اید"}
DEMONSTRATIVES = ("این", "اون", "آن", "همین", "همون", "همان")
TANVIN_ADVERBS = frozenset(
    """مثلا معمولا ظاهرا واقعا اخیرا تقریبا اصلا کاملا لطفا حتما دقیقا فعلا بعدا قبلا ناچارا احتمالا اولا ثانیا ثالثا اساسا
    اتفاقا عمدا فورا شخصا مجددا مستقیما نسبتا کلا اکثرا غالبا عملا رسما صرفا تماما شدیدا جدا حقیقتا بعضا ابدا دائما
    مطمئنا قطعا یقینا اصولا ضمنا مخصوصا خصوصا نهایتا مسلما عموما موقتا مرتبا سریعا احیانا لزوما طبیعتا ذاتا حدودا اصطلاحا""".split()
)
NUMBER_WORDS = frozenset(
    """یک دو سه چهار پنج شش هفت هشت نه ده یازده دوازده سیزده چهارده پانزده شانزده هفده هجده هیجده نوزده
    بیست سی چهل پنجاه شصت هفتاد هشتاد نود صد یکصد دویست سیصد چهارصد پانصد ششصد هفتصد هشتصد نهصد هزار میلیون میلیارد""".split()
)
# Words of chat, and of written register.
CHAT_WORDS = tuple(
    """سلام خوبی خوبین خوبید خوبم مرسی ممنون ممنونم مچکرم باشه آره نه‌خیر خداحافظ خدافظ بای فعلا شب‌بخیر صبح‌بخیر عزیزم قربونت قربونتم فدات فداتشم دمت مخلصیم چاکرم ایول آفرین حله اوکی اوکیه باحال باحاله
    چطوری چطورین چطوره کجایی کجاین کجاس چیکار چیکارا چکار چته چیه چیشد کیه
    میخوام نمیخوام میخوای میخوایم میدونم نمیدونم میدونی نمیدونی میام نمیام میای میاین میرم نمیرم میری بریم بیا بیاین ببین ببینم میبینمت میگم میگی بگو بگم نمیشه میشه
    خونم حوصلم خستم خیالت اینجوری اونجوری اونجا یکم یه اون اینو اونو بهت بهم باهات باهم واسه واسم واست""".split()
)
WRITTEN_WORDS = tuple("است هستند می‌باشد می‌باشند می‌شود می‌شوند می‌کند می‌کنند می‌دهد می‌دهند می‌رود می‌روند می‌آید می‌آیند می‌خواهم می‌خواهد می‌خواهی نمی‌دانم نمی‌خواهم را دارد ندارد شده‌اند آیا".split())
#: What a typed vowel run can stand for; any other run can be any vowel.
TYPED_VOWELS = {"a": "Aa", "aa": "A", "e": "e", "o": "o", "i": "i", "ee": "i", "ii": "i", "y": "i", "u": "u", "oo": "u", "ou": "u", "uu": "u"}
ANY_VOWEL = "aeoAiu"


@cache
def latin_units() -> list[str]:
    """Latin spellings of the correspondences and the letters, longest first."""
    units = {s for _, spellings, *_ in CORRESPONDENCES for s in spellings if s} | set("abcdefghijklmnopqrstuvwxyz'")
    # the order within a length never decides a match: no unit of one length is the start of another of it
    return sorted(units, key=lambda u: (-len(u), u))


@cache
def reverse_index() -> dict[tuple[str, str], list[tuple[str, float, bool]]]:
    """(unit, position) to Persian spellings with weight and whether the unit is their first spelling, heaviest first.

    The weight of a spelling is divided by its rank among the letter's spellings; entries of the same letter add up.
    """
    out: dict[tuple[str, str], dict[str, tuple[float, bool]]] = {}
    for fa, spellings, positions, _, w in CORRESPONDENCES:
        for rank, unit in enumerate(spellings):
            for pos in positions if unit else ():
                had = out.setdefault((unit, pos), {})
                weight, first = had.get(fa, (0.0, False))
                had[fa] = (weight + w / (rank + 1), first or rank == 0)
    return {k: sorted(((fa, w, c) for fa, (w, c) in v.items()), key=lambda x: -x[1]) for k, v in out.items()}


def first_choice() -> dict[str, str]:
    """'unit|position' to the heaviest Persian spelling."""
    return {f"{unit}|{pos}": found[0][0] for (unit, pos), found in reverse_index().items()}
