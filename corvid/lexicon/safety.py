"""Word lists that results depend on, as given, in natural order."""

MARKERS = (
    "انتحار", "انتحر", "نتحر", "اقتل نفسي", "اودي بنفسي", "اودي نفسي", "انهي حياتي", "انهاء حياتي", "اريد ان اموت", "اريد الموت", "اريد اموت",
    "اتمني الموت", "اتمني الموت", "اتمنا الموت", "اتمني اموت", "اتمنا اموت", "نفسي اموت", "ودي اموت", "حاب نموت", "حاب اموت", "نحب نموت",
    "بغيت نموت", "بدي اموت", "ابغي اموت", "ابغا اموت", "ابغي الموت", "ابغا الموت", "بغا اموت", "يبغي اموت", "نبغي نموت", "نبي نموت",
    "ودي اموت وارتاح", "ودي ارتاح من الدنيا", "ودي ارتاح من الحياه", "ايذاء نفسي", "ايذاء النفس", "ايذي نفسي", "اجرح نفسي", "اجرح نفسي",
    "لا اريد ان اعيش", "لا اريد العيش", "ما نيش حاب نعيش", "ماني حاب نعيش", "مانيش حاب نعيش", "لا رغبه لي في الحياه", "سيمت الحياه",
    "سيمت من الحياه", "تعبت من الحياه", "تعبت من الدنيا", "تعبت من هالدنيا", "تعبت من العيش", "زهقت من الحياه", "زهقت من الدنيا", "مللت من الحياه",
    "مللت من الدنيا", "ييست من الحياه", "ييست من الدنيا", "ما اقدر اكمل", "ما عاد اقدر اكمل", "ما عاد فيني اكمل", "ما فيني اكمل", "ما قادر اكمل",
    "مش قادر اكمل", "مو قادر اكمل", "ما اقدر استمر", "ما ابي اعيش", "ما ابغي اعيش", "ما ابغا اعيش", "ما نبي نعيش", "ما ودي اعيش", "ما ودي اكمل",
    "ما عاد ودي اعيش", "قتل النفس", "suicide", "kill myself", "end my life", "self harm", "selfharm", "want to die", "hurt myself",
    "dont want to live", "don t want to live", "no reason to live", "nothing to live for", "better off dead", "better if i die",
    "better if i was dead", "end it all", "ending it all", "take my own life", "take my life", "not worth living", "want to disappear", "cant go on",
    "can t go on", "give up on life", "off myself", "killing myself", "hanging myself", "hang myself", "cut my wrists", "cutting myself",
    "cut my wrist", "overdose", "over dose", "swallow pills", "jump off", "throw myself", "no point in living", "tired of living", "end everything",
    "stop existing", "الموت هو الحل", "الموت الحل الوحيد", "غير الموت قدامي", "الموت قدامي", "الموت امامي", "ما اشوف غير الموت", "ما اري غير الموت",
    "خلص علي نفسي", "ما احد بيحس لو اختفيت", "ماحد بيحس", "ما احد يحس لو", "ولا احد يحس لو", "ما احد بيفتقدني", "ماحد يفتقدني", "لو اختفيت ما احد",
    "ما اكون موجود", "لو ما كنت موجود", "احسن اني ما اكون", "ياليتني ما خلقت", "ليتني ما خلقت", "ياليتني مت", "ليتني مت", "لو اني مت",
    "ما باقي لي شي", "ما باقي لي شيء", "ما بقا لي شي", "حياتي ما لها لازمه", "حياتي ما لها قيمه", "حياتي ما لها معني", "وجودي ما له معني",
    "ما لي رغبه في الحياه", "بكتب وصيتي", "جهزت كل شي للانتحار",
)

NEGATION = (
    "لا", "ما", "مش", "مو", "ليس", "ليست", "لسنا", "ماني", "مانيش", "ماش", "ماشي",
)

DESIRE = (
    "اريد", "ارغب", "رغب", "ابغي", "ابغا", "بغي", "بغيت", "يبغي", "يبغا", "يبي", "يبا", "نبي", "نبغي", "نبغا", "ودي", "وديت", "بدي", "حاب", "حابه",
    "نحب", "بحب", "اتمني", "اتمنا", "تمنيت", "مشتهي", "نفسي", "نفس", "محتاج", "عايز", "عايزه", "عاوز", "عاوزه", "ليت", "حابب",
)

DEATH = (
    "اموت", "موت", "موتي", "نموت", "يموت", "تموت", "اتموت", "اتوفي", "توفي", "توفاني", "وفاتي", "الوفاه", "انتحر", "انتحار", "انتحاري", "يموتا",
)

LIVE = (
    "اعيش", "عيش", "العيش", "نعيش", "تعيش", "حياه", "الحياه", "نحيي", "احيي", "يحيي", "نحيا", "اكمل", "استمر", "استمرار", "اقدر", "اكدر", "قادر",
    "قادره", "فيني", "طاقه", "باقي", "بقي", "بقايي",
)

PERSONAL_LIVE = (
    "اعيش", "عيش", "نعيش", "تعيش", "اكمل", "استمر", "اقدر", "اكدر", "بقايي", "نحيي", "احيي",
)

REST_VERBS = (
    "ارتاح", "استريح", "اريح", "برتاح", "نرتاح", "ارتاحي", "ارتاحو", "اتخلص", "اتحرر", "اهرب", "ارتاحوا", "استريحي",
)

LIFE_BURDEN = (
    "الدنيا", "دنيا", "هالدنيا", "الحياه", "حياه", "هالحياه", "العيشه", "هالعيشه", "العالم", "الوجود", "الكون", "هادنيا",
)

LIFE_SELF = (
    "حياتي", "حياتنا", "حياته", "حياتها", "حياتهم", "وجودي", "وجوده", "وجودها", "بقايي", "بقايه", "بقاه", "عمري",
)

DEPARTURE = (
    "اختفي", "ارحل", "امشي", "اترك", "اخرج", "اهرب", "اتلاشي", "اختفيت",
)

SELF_BURDEN = (
    "عبء", "عبو", "عاله", "عالي", "ثقيل", "حمل", "زايد", "عبيا",
)

NEGATION_OR_INABILITY = (
    "لا", "ما", "مش", "مو", "ليس", "ليست", "لم", "لن", "ماني", "مانيش", "ماش", "ماشي", "ييست", "فقدت",
)

FOREVER = (
    "الابد", "ابد", "ابديه", "ابدي", "نهاييا", "خلاص", "لابد",
)

END_VERBS = (
    "تنتهي", "ينتهي", "انتهاء", "تخلص", "تقف", "تنته", "ينته", "انهي", "ينهي", "تنهي", "انهيه", "انهيها", "انهيهم",
)

DECISION = (
    "قررت", "قررنا", "عزمت", "نويت", "حسمت", "خلصت", "اخترت",
)

METHOD = (
    "اشنق", "شنق", "اخنق", "خنق", "اقطع", "قطع", "احرق", "حرق", "ارمي", "رمي", "اقتل", "قتل", "اذبح", "ذبح", "اغرق", "غرق", "اطعن", "طعن",
)

SELF_OBJECT = (
    "نفسي", "نفس", "حالي", "حال", "روحي", "روح", "ذاتي", "شراييني", "شرايين", "معصمي", "معاصمي", "رسغي", "رسغ", "وريدي", "يدي", "عنقي", "رقبتي",
)

METHOD_SEEK = (
    "طريقه", "طرق", "وسيله", "وسايل", "اسهل", "اسرع", "كيفيه", "كيف", "ادور", "دور", "ابحث", "فتش", "وصفه", "طريق",
)

OVERDOSE = (
    "حبوب", "حبه", "حبات", "منوم", "منومه", "منومات", "مهدي", "مهديات", "سم", "سموم", "جرعه", "جرعات", "ملغ", "مليجرام", "ملجم", "عقاقير", "اقراص",
    "قرص",
)

PREPARATION_VERBS = (
    "كتبت", "بكتب", "جهزت", "جهزه", "اعددت", "حضرت", "ودعت", "وزعت", "انهيت",
)

HOPELESS = (
    "لازمه", "قيمه", "معني", "فايده", "طعم", "هدف", "مبرر", "داعي", "ثمن", "اهميه", "معناها", "لازم",
)

MEANING = (
    "سبب", "اسباب", "مبرر", "داعي", "فايده", "قيمه", "معني", "هدف", "لازمه",
)

EXHAUSTION = (
    "تعبت", "تعبان", "تعبانه", "مليت", "مللت", "زهقت", "زهقان", "ييست", "طفحت", "قرفت", "هلكت", "اعيت", "اعيان", "مخنوق", "مختنق", "ضايق", "تضيق",
    "ضاقت", "ييس", "قنطت",
)

FEELING = (
    "احس", "اشعر", "احساس", "شعور", "شاعر", "شاعره", "حاسس", "حاسه", "حسيت", "احسست",
)

PERSON = (
    "اهلي", "اهل", "اسرتي", "اسره", "عايلتي", "عايله", "امي", "ابوي", "ابي", "اخوي", "اخوتي", "اخواتي", "زوجتي", "زوجي", "الناس", "احد", "غيري",
    "الكل", "اصدقايي", "ولدي", "بنتي", "من حولي",
)

OTHER_TARGET = (
    "اعداء", "عدو", "عدوي", "الظالم", "الظالمين", "الكفار", "الكافرين", "المشركين", "المنافقين", "فلان", "غيري", "اليهود",
)

RESEARCH_FRAME = (
    "ذكر", "تذكر", "اتذكر", "اذكر", "اتعظ", "عظه", "بحث", "موضوع", "مواضيع", "حكم", "احكام", "فتوي", "حديث", "احاديث", "ايه", "ايات", "تفسير",
    "معني", "معاني", "قصه", "قصص", "روايه", "سكرات", "احتضار", "جنازه", "جنايز", "قبر", "قبور", "الاموات", "الموتي", "ميت", "خوف", "الاستعداد",
    "استعداد", "اداب", "فضل", "دليل", "علامات", "تعلم", "دراسه", "فهم", "معرفه", "قراءه", "شرح", "كتاب", "رساله", "عقيده", "ايمان", "يقين", "شوق",
    "لقاء", "تغيير", "تغير", "استعد", "شهيدا", "شهيد", "الجنه", "الفردوس", "الاخره", "القيامه", "البرزخ", "الخاتمه", "مواريث", "الميراث", "الزهد",
    "الرقاق", "التذكير",
)

PATTERNS = (
    r"(?:^|\s)اريد(?:\s+ان)?\s+اموت(?:\s|$)",
    r"(?:^|\s)اتمني(?:\s+ان)?\s+اموت(?:\s|$)",
    r"(?:^|\s)اتمنا(?:\s+ان)?\s+اموت(?:\s|$)",
    r"(?:^|\s)نفسي\s+اموت(?:\s|$)",
    r"(?:^|\s)(?:ودي|حاب|بدي|بغيت|نحب|حاب)\s+(?:ان\s+)?اموت(?:\s|$)",
    r"(?:^|\s)اريد\s+الموت(?:\s|$)",
    r"(?:^|\s)اتمني\s+الموت(?:\s|$)",
    r"(?:^|\s)اتمنا\s+الموت(?:\s|$)",
    r"(?:^|\s)(?:ابغي|ابغا|بغا|يبغي|نبغي|نبي)\s+(?:ان\s+|اني\s+)?(?:اموت|الموت|نموت|اتوفي)(?:\s|$)",
    r"(?:^|\s)(?:الموت|موت)\s+(?:اريح|ارياح|احسن|افضل|راحه|نعمه)(?:\s|$)",
    r"(?:^|\s)(?:اريح|احسن|افضل|اولي)\s+(?:لي|لنا|اني)?\s*(?:اموت|الموت|موتي)(?:\s|$)",
    r"(?:^|\s)(?:ارتاح|ارتاحن|استريح|برتاح|نرتاح|اريح)\s+(?:من\s+)?(?:الدنيا|هالدنيا|الحياه|حياتي|العيشه|هالعيشه|العالم)(?:\s|$)",
    r"(?:^|\s)(?:ودي|ابغي|ابغا|اريد|نبي|بدي|حاب)\s+(?:ان\s+|اني\s+)?(?:اختفي|ارحل|امشي|اترك)\s+(?:من\s+)?(?:الدنيا|هالدنيا|الحياه|العالم)(?:\s|$)",
    r"(?:^|\s)(?:ما|لا|مو|مش)\s+(?:اصحي|اصح|استيقظ|افوق|اقوم)\s+(?:من\s+)?(?:نومي|النوم)(?:\s|$)",
    r"(?:^|\s)نومه\s+ما\s+بعدها\s+قيام(?:\s|$)",
    r"(?:^|\s)وداعا\s+(?:يا\s+)?(?:اهلي|الجميع|كل|اصحابي|احبايي|حبايبي|الناس|اصدقايي)(?:\s|$)",
    r"(?:^|\s)(?:هذي|هذه|دي|هاي)\s+(?:اخر|اخر)\s+(?:رساله|رسال|مره|مره|كلام|كلمه|لقاء)(?:\s|$)",
    r"(?:^|\s)(?:خلاص|راح)\s+(?:برتاح|ارتاح|اموت|خلصت|تخلصت)(?:\s|$)",
    r"(?:^|\s)ما\s+(?:راح|بت|ح)\s+(?:تشوفوني|تسمعون|تسمعين|تشوفون)(?:\s|$)",
)
