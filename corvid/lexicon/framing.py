"""Word lists that results depend on, as given, in natural order."""

FORBIDDEN_PHRASES = (
    "تشخيص حالتك", "تشخيصك هو", "تشخيصك:", "أنت مصاب", "انت مصاب", "حالتك هي", "مرضك هو", "مرضك:", "دواؤك هو", "دواؤك:", "علاج حالتك", "علاجك هو",
    "وصفة روحية", "وصفه روحيه", "برنامج روحاني", "برنامج روحي لك", "خطة علاجك", "خطه علاجك", "إصابتك", "اصابتك", "تعاني من مرض", "مصاب بمرض",
)

DISCOURAGED_TERMS = (
    "الروحية", "الروحانيه", "روحانية",
)

BOOK_SUFFIXES = (
    "صحيح البخاري", "صحيح مسلم", "سنن أبي داود", "سنن الترمذي", "سنن النسائي", "سنن ابن ماجه", "موطأ مالك", "صحيح ابن حبان", "صحيح ابن خزيمة",
    "المستدرك على الصحيحين", "مسند أحمد", "الأحاديث المختارة", "المنتقى", "السنن الكبرى", "مسند أبي يعلى الموصلي", "مصنف ابن أبي شيبة",
    "مصنف عبد الرزاق", "فتح الباري", "عمدة القاري", "شرح النووي على مسلم",
)

UI_NOISE = (
    "إضافة تعليق", "تحليل الحديث", "مقارنة المتون", "الشواهد", "متن مجمع", "الإسناد", "غريب الحديث", "الربط الموضوعي", "الربط بالمخالف", "المتواتر",
    "الأعلام والأماكن", "الرواة", "راوي الحديث", "راوي أعلى", "بحث نصي", "بحث في الموضوعات", "تسجيل الدخول",
)

ENTITIES = {
    "amp": '&',
    "lt": '<',
    "gt": '>',
    "quot": '"',
    "apos": "'",
    "nbsp": '\u00a0',
    "ensp": '\u2002',
    "emsp": '\u2003',
    "thinsp": '\u2009',
    "zwnj": '\u200c',
    "zwj": '\u200d',
    "lrm": '\u200e',
    "rlm": '\u200f',
    "middot": '\u00b7',
    "laquo": '\u00ab',
    "raquo": '\u00bb',
    "times": '\u00d7',
    "divide": '\u00f7',
    "ndash": '\u2013',
    "mdash": '\u2014',
    "lsquo": '\u2018',
    "rsquo": '\u2019',
    "sbquo": '\u201a',
    "ldquo": '\u201c',
    "rdquo": '\u201d',
    "hellip": '\u2026',
    "bull": '\u2022',
    "dagger": '\u2020',
    "deg": '\u00b0',
    "copy": '\u00a9',
    "reg": '\u00ae',
    "trade": '\u2122',
    "shy": '\u00ad',
    "lre": '\u202a',
    "rle": '\u202b',
    "pdf": '\u202c',
    "percent": '%',
}
