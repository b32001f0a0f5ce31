"""Word lists that results depend on, as given, in natural order."""

DIAGNOSIS = (
    "شخصني", "شخص حالتي", "ما تشخيصي", "ما التشخيص", "هل انا مصاب", "هل أنا مصاب", "هل عندي مرض", "هل انا مريض", "هل أنا مريض", "هل انا مريض نفسي",
    "هل أنا مريض نفسي", "هل انا مريض نفسيا", "هل أنا مريض نفسيا", "هل عندي اضطراب", "هل اعاني من", "هل أعاني من", "هل انا مكتئب", "هل أنا مكتئب",
    "هل عندي اكتئاب", "هل عندي سكري", "هل عندي سكر", "هل عندي ضغط", "هل هذا مرضي", "هل هذه حالتي", "هل يمكن ان اكون مصاب", "هل يمكن أن أكون مصاب",
    "ما المرض الذي عندي", "ما هو مرضي", "ما مرضي", "ما هي حالتي", "ما حالتي", "ما الذي بي", "ما فيني", "وش فيني", "شنو فيني", "واش فيني",
    "ما الذي اعاني منه", "ما الذي أعاني منه", "ما الذي فيني", "اظن ان عندي", "أظن أن عندي", "اعتقد ان عندي", "أعتقد أن عندي", "اشك ان عندي",
    "أشك أن عندي", "اشك اني", "أشك أني", "اشك باني", "شاك ان عندي", "وش تشخيصي", "شو تشخيصي", "شنو تشخيصي", "ما تشخيصي", "تشخيص حالتي", "شخص حالتي",
    "اشخص لي", "شخص لي", "ايش تشخيصي", "هل هذا مرض", "هل هذا اضطراب", "هل هي حاله مرضيه", "هل هذه حالة مرضية", "هل حالتي مرضيه", "هل حالتي طبيعيه",
    "هل انا طبيعي", "هل أنا طبيعي", "هل ما اعاني منه مرض", "هل ما أعاني منه مرض", "وش عندي", "ايش عندي", "وش اللي عندي", "ايش اللي عندي", "وش فيني",
    "ايش فيني", "وش اللي فيني", "وش عندي من مرض", "وش مرضي", "ايش مرضي", "وش تشخيصي", "ايش تشخيصي", "وش تشخيص حالتي", "ابغى تشخيص", "ابي تشخيص",
    "اعطني تشخيص", "اعطيني تشخيص", "شخصني", "شخص لي حالتي", "شخصي حالتي", "شخص وضعي", "انا مريض ولا", "انا مريضه ولا", "اني مريض ولا", "مريض ولا وش",
    "مريضه ولا وش", "عندي مرض ولا", "عندي اكتئاب ولا", "عندي وسواس ولا", "عندي قلق ولا", "مصاب ولا", "مصابه ولا", "انا مجنون", "انا مجنونه",
    "مجنون ولا", "مجنونه ولا", "ولا انا مريض", "ولا وش", "وش حالتي", "ايش حالتي",
)

RULING = (
    "ما حكم", "ما حكم الشرع", "هل يجوز", "هل يحرم", "هل هذا حلال", "هل هذا حرام", "حلال ام حرام", "حلال أم حرام", "افتني", "افتي", "اطلب فتوى",
    "اطلب فتوي", "اريد فتوى", "اريد فتوي", "أريد فتوى", "فتوى", "فتوي", "فتواكم", "هل علي اثم", "هل علي إثم", "هل ااثم", "هل ذنبي يغفر",
    "هل ذنبي هذا يغفر لي", "هل يغفر الله لي بعد", "ماذا افعل شرعا", "ماذا أفعل شرعاً", "ما الواجب علي شرعا", "ما الواجب علي شرعاً", "هل يصح صيامي",
    "هل يصح حجي", "ما كفارة", "الفتوى في", "ما هي الفتوى في", "ما هو حكم", "حكم هذا", "حكم ذلك", "وش حكم", "ايش حكم", "وش الحكم", "ايش الحكم",
    "شو حكم", "شنو حكم", "حكمه ايش", "حكمها ايش", "حكمهم ايش", "حكمه وش", "حكمها وش", "ماهو حكم", "ماهو الحكم", "ما هو الحكم", "ما الحكم",
    "ايه الحكم", "يجوز ولا ما يجوز", "يجوز ولا", "يجوز او لا", "يجوز و", "حلال ولا حرام", "حلال او حرام", "حلال والا حرام", "حرام ولا حلال",
    "وش راي الشرع", "راي الشرع", "وش يقول الشرع", "راي الدين في", "وش راي الدين", "الحكم الشرعي", "الحكم الديني", "الفتوي الشرعيه", "علي اثم",
    "علي ذنب", "هل ياثم", "ياثم من", "هل عليه اثم", "هل فيه اثم", "افتوني", "افتونا", "يفتيني", "يفتي في", "ابغى فتوي", "ابي فتوي", "ودي فتوي",
    "عطني حكم", "اعطني حكما", "ابغى اعرف الحكم", "ابي اعرف الحكم",
)

PERSONAL_CASE = (
    "طلقت زوجتي", "طلقتها فما الحكم", "وقع الطلاق فما الحكم", "وقع الطلاق", "ارث الميت", "إرث الميت", "تركة الميت", "تركه الميت", "زكاة مالي",
    "زكاه مالي", "أتعامل بالربا", "اتعامل بالربا", "نذرت", "حلفت", "انتهت عدتي", "انتهت عدتي", "أرضعت", "ارضعت", "صيامي", "حجي",
)

RULING_STARTERS = (
    "هل", "وهل", "وش", "ايش", "ايه", "ما", "ماذا", "شنو",
)

RULING_PREDICATES = (
    "حرام", "حلال", "جائز", "مباح", "مكروه", "واجب", "فرض", "مفروض", "محرم", "مسموح", "باطل", "يصح", "يجب", "تجب",
)

DEFINITION_CUES = (
    "معنى", "تعريف", "المقصود", "لغة",
)

PRESCRIPTION = (
    "اعطني علاجا", "اعطني علاج", "أعطني علاجاً", "أعطني علاج", "اعطني دواء", "أعطني دواء", "شنو ناخذ", "وش ناخذ", "ماذا ناخذ", "ما ناخذ",
    "ما الدواء الذي استعمله", "ما الدواء الذي أستعمله", "اي دواء استعمل", "أي دواء أستعمل", "ما الجرعه التي اخذها", "ما الجرعة التي آخذها",
    "كم الجرعه التي اخذها", "كم الجرعة التي آخذها", "ماذا اخذ", "ماذا آخذ", "كيف اعالج نفسي", "كيف أعالج نفسي", "كيف اتعالج", "كيف أتعالج",
    "كيف نداوي نفسي", "كيف نداوي روحي", "كيف نعالج نفسي", "وصفة علاج", "وصفه علاج", "اكتب لي وصفة", "اكتب لي وصفة علاج", "وصفه لي", "وصفة لي",
    "وصف لي", "ضع لي خطة علاج", "ضع لي خطة علاجية", "اعطني برنامجا علاجيا", "أعطني برنامجاً علاجياً", "خطة علاج شخصية", "برنامج علاج شخصي",
    "روتين علاجي لي", "خطوات علاجية لي", "خطوات علاجيه لي", "ما العلاج الذي يناسبني", "ما الدواء المناسب لي", "وش الدواء المناسب لي",
    "شنو الدواء المناسب لي", "ما العلاج المناسب لي", "وش العلاج المناسب لي", "شنو العلاج المناسب لي", "ما الذي استعمله لعلاج", "ماذا استعمل لعلاج",
    "كيف أعالج هذا", "كيف اعالج هذا", "كيف أعالج حالتي", "كيف اعالج حالتي", "step by step for me", "جرعه الدواء", "جرعه دواء", "جرعه العلاج",
    "جرعه علاج", "الجرعه المناسبه", "الجرعة المناسبة", "ما هي جرعه", "ما هي جرعة", "كم جرعه", "كم جرعة", "جرعات", "ملجم", "مليجرام", "كم حبه",
    "كم حبة", "حبه دواء", "حبة دواء", "حبات دواء", "حبوب منومه", "حبوب منومة", "دواء منوم", "مهدئ", "مهدئات", "خطه علاجيه", "خطة علاجية",
    "خطه علاجي", "خطة علاجية لي", "برنامج علاجي", "روتين علاجي", "وصفه طبيه", "وصفة طبية", "ابغي خطه علاج", "أبغى خطة علاج", "ودي خطه علاج",
    "علاج شخصي لي", "علاجي الشخصي", "prescribe me", "what dose", "how many pills", "dosage for me", "treatment plan for me", "medication for me",
    "وش اخذ من دواء", "ايش اخذ من دواء", "وش اخذ دواء", "ايش اخذ دواء", "وش الدوا المناسب", "ابغى حبوب", "ابي حبوب", "عطني حبوب", "اعطيني حبوب",
    "حبوب تنومني", "حبوب تنويم", "حبوب تنوم", "حبه تنومني", "عطني روشتة", "روشتة", "روشته", "ابغى روشتة", "اكتب لي روشتة", "اي حبه", "اي حبة استعمل",
    "وش الحبه", "كم ملغ", "كم مليجرام", "كم ملجم", "كم مغ", "ابغى دواء للنوم", "ابي دواء للنوم", "عطني منوم", "ابي منوم",
)

QUANTITY_CUES = (
    "كم", "كميه", "مقدار", "عدد", "اعطني", "اعطيني", "حدد", "وصف",
)

INTAKE_CUES = (
    "اخذ", "اشرب", "استعمل", "استخدم", "ابتلع", "اصرف", "اجرب", "تناول", "اكل",
)

CONDITION_CUES = (
    "قلق", "القلق", "اكتئاب", "الاكتئاب", "ارق", "الارق", "اضطراب", "الاضطراب", "ذهان", "هلع", "رهاب", "صرع", "نفسي", "نفسيه", "احباط",
    "امراض نفسيه", "مرض نفسي", "ضغط نفسي", "وسواس قهري", "قهري", "سكري", "السكري", "ضغط", "صداع نصفي", "نصفي", "امراض", "الامراض",
)

MEDICATION_CUES = (
    "دواء", "ادويه", "ادوية", "حبه", "حبوب", "جرعه", "جرعات", "منوم", "منومه", "مهدئ", "مهدئات", "دوائي", "ملجم", "عقار", "اقراص", "حبتي",
)

HEALTH = (
    "صداع", "حمى", "حراره", "حرارة", "اعراض", "أعراض", "دواء", "جرعه", "جرعة", "سكر", "سكري", "ضغط", "ربو", "حساسيه", "حساسية", "معدة", "المعده",
    "اكتئاب", "اضطراب نفسي", "نوبات هلع", "أرق", "مرض نفسي", "صحه نفسيه", "صحة نفسية", "طبيب", "تحاليل", "تشخيص طبي",
)

#: (word, label), the first that occurs wins.
MATTERS = (
    ("طلاق", "مسألة في الطلاق"),
    ("طلقت", "مسألة في الطلاق"),
    ("ميراث", "مسألة في الميراث"),
    ("تركه", "مسألة في الميراث"),
    ("زكاه", "مسألة في الزكاة"),
    ("ربا", "مسألة في الربا"),
    ("نذر", "مسألة في النذور"),
    ("كفاره", "مسألة في الكفارات"),
    ("حلفت", "مسألة في الأيمان"),
    ("عده", "مسألة في العدّة"),
    ("رضاع", "مسألة في الرضاع"),
    ("حيض", "مسألة في الحيض"),
    ("حايض", "مسألة في الحيض"),
    ("صلاه", "مسألة في الصلاة"),
)
