"""Word lists that results depend on, as given, in natural order."""

STOPWORDS = (
    "في", "من", "علي", "الي", "عن", "ان", "ما", "لا", "لم", "لن", "قد", "هو", "هي", "هذا", "هذه", "ذلك", "تلك", "التي", "الذي", "او", "بل", "ثم",
    "كيف", "ماذا", "هل", "انا", "انت", "نحن", "هم", "كل", "بعد", "قبل", "عند", "مع", "كان", "كانت", "يكون", "لي", "له", "لها", "فيها", "فيه", "عليه",
    "اليه", "منها", "منه", "بما", "كما", "اذا", "اذ", "لو", "لولا", "ولا", "فلا", "ولم", "وقد", "وكان", "لقد", "جدا", "بشده", "الان", "دائما",
    "احيانا", "كثير", "شيء", "شي", "ايضا", "غير", "بين", "حتي", "منذ", "ضد", "مثل", "عبر", "حول", "دون", "لدي", "عندي", "معي", "the", "a", "an",
    "of", "to", "in", "is", "i", "me", "my", "and", "or",
)

GENERIC_TOKENS = (
    "الله", "الناس", "العبد", "العباد", "الدنيا", "الاخره", "شيء", "امر", "امور", "موضوع", "موضوعات", "بحث", "ماده", "مادة", "العلم", "العلمية",
    "الحديث", "السؤال", "معنى", "معني", "معاني", "كلمه", "كلمة", "تعريف", "مفهوم", "شرح", "مصطلح", "ما", "من", "هو", "هي", "في", "عن", "هل", "هذا",
    "هذه", "ذلك", "تلك", "الى", "لماذا", "كيف", "ماذا", "اريد", "أريد", "رأي", "راي", "قول", "أفضل", "افضل", "الرسالة", "رسالة", "الرساله", "رساله",
    "الرسمية", "الرسميه", "الرسمي", "رسمي", "المنشورة", "المنشوره", "منشورة", "منشوره", "المنشور", "منشور", "لاعب", "كرة", "كره", "قدم", "الاول",
    "الأول", "كامل", "كاملة", "تفسير", "ايه", "آيه", "اية", "آية", "سورة", "سوره",
)

QURAN_HINTS = (
    "قرآن", "مصحف", "آية", "اية", "آيه", "ايه", "سورة", "سوره",
)

AUTHORITY_HINTS = (
    "رأي", "راي", "قول", "موقف",
)

IGNORED_AUTHOR_TOKENS = (
    "الشيخ", "شيخ", "الإمام", "الامام", "رحمه", "الله", "بن", "ابن", "عبد", "الرئاسة", "رئاسة", "العامة", "العلمية", "علميه", "بحوث", "الإفتاء",
    "افتاء", "شركة", "حرف", "تقنية", "لتقنية", "معلومات", "تعاون", "مجمع", "ملك", "لطباعة", "مصحف", "شريف", "القرآن", "قران", "كريم", "وتفسير",
    "ميسر", "محمد", "عبدالعزيز", "عبد", "الاسلام", "اسلام", "الدين", "دين", "علامه", "محدث", "فقيه", "نص", "تفسير", "العزيز", "عزيز", "السنة", "سنه",
    "النبوية", "نبويه",
)

QURAN_CUES = (
    "تفسير", "تفسيرا", "معنى", "معاني", "شرح", "اعراب", "سبب النزول", "سبب نزول", "قراءه", "قراءات", "ما تفسير", "ما معنى", "ما اعراب",
)

#: (word, replacement), applied in this order.
DIALECT = (
    ("واعر", "قاس"),
    ("واعره", "قاسية"),
    ("بزاف", "كثير"),
    ("كفاه", "كيف"),
    ("نديرو", "نفعل"),
    ("ندير", "أفعل"),
    ("غالطتني", "أخطأت"),
    ("مقصر", "مقصر"),
    ("قلقان", "قلق"),
    ("زهقت", "سئمت"),
    ("عايز", "أريد"),
    ("ماشي", "ذاهب"),
    ("كده", "هكذا"),
    ("اللي", "الذي"),
    ("مش", "ليس"),
    ("مو", "ليس"),
    ("يبه", "يا أبي"),
    ("شلون", "كيف"),
    ("شو", "ما"),
    ("ليش", "لماذا"),
    ("دلوقتي", "الآن"),
    ("كيف نقدر", "كيف نستطيع"),
    ("هواجيس", "وساوس"),
    ("هواجس", "وساوس"),
    ("يقلقني", "يقلقني"),
    ("مقلق", "مقلق"),
    ("متضايق", "منزعج"),
    ("زهجت", "سئمت"),
    ("تعبان", "متعب"),
    ("زعلان", "حزين"),
)
