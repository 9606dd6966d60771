"""Kinds of facilities: ordered rules over the name, then the register's own guess, then what the staff does [C1]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import facility_words

# Kinds in the order in which their words are looked for; the first that matches wins.
NAME_RULES = [
    ("hospital", "hospital|medical city|infirmary"),
    ("day_surgery", "day surgery|day surgical|daysurgery|surgical centre|surgery centre|ambulatory surgery"),
    ("polyclinic", "polyclinic|poly clinic"),
    ("pharmacy", "pharmacy|pharma|pharmacie|pharamcy|phrmacy|drug store|drugstore|chemist|apothecary|nahdi|boots"),
    ("dental", "dental|dentist|dentistry|dentalcare|orthodontic|orthodontics|endodontic|periodontic|implantology|denture|teeth|tooth"),
    ("optical", "optical|optics|optic|optician|opticians|optometry|eyewear|eye wear|spectacles|glasses|sunglasses|eyeglasses|magrabi|yateem"),
    ("laboratory", "laboratory|lab|pathology|histopathology|cytology|genomics|genomic|genetics|biolab|medlab|blood bank|bloodbank"),
    ("diagnostic_center", "diagnostic|diagnostics|diagnosis|imaging|radiology|radiologic|mri|ct scan|ultrasound|sonography|screening|scan|scanning|x ray|xray|mammography|endoscopy"),
    ("physiotherapy", "physiotherapy|physiotherapies|physio|physical therapy|rehabilitation|rehab|chiropractic|chiropractor|osteopathy|osteopathic|podiatry|prosthetic|prosthetics|orthotic|orthotics"),
    ("home_healthcare", "home health|home healthcare|home health care|homehealth|home care|homecare|home nursing|home medical|at home|domiciliary"),
    ("nursing", "nursing|nurses|nurse|care home|caregiver|caregivers|elderly|geriatric|long term care|hospice|palliative"),
    ("mental_health", "psychology|psychological|psychiatry|psychiatric|psychotherapy|psychiatrist|psychologist|mental health|mental|behavioural|behavioral|behaviour|behavior|autism|counselling|counseling|counsellor|speech therapy|occupational therapy|wellbeing|well being|psyche|neurofeedback"),
    ("maternity", "maternity|fertility|ivf|obstetric|obstetrics|gynecology|gynaecology|birthing|midwifery|lactation|reproductive|fetal|foetal|neonatal"),
    ("veterinary", "veterinary|veterinarian|vet|vets|animal|animals"),
    ("medical_supplier", "medical supplies|medical supply|medical equipment|medical equipments|surgical supplies|surgical equipment|medical devices|medical device|prosthesis|hearing aid|hearing aids|supplies|supply|equipment|equipments|manufacturing|manufacture|printing|retail|distribution|wholesale"),
    ("aesthetic", "aesthetic|aesthetics|esthetic|esthetics|cosmetic|cosmetics|cosmetology|beauty|laser|skin|derma|dermatology|dermatologic|plastic surgery|cosmetic surgery|slimming|salon|salons|hair|nails|grooming|barber|makeup|tattoo|piercing|brow|lash|botox|filler|fillers"),
    ("alternative", "ayurveda|ayurvedic|ayurved|homeopathy|homeopathic|homoeopathy|homoeopathic|unani|acupuncture|chinese medicine|tcm|naturopathy|naturopathic|herbal|herbs|yoga|meditation|reiki|hijama|cupping|holistic|siddha|panchakarma"),
    ("wellness", "wellness|spa|spas|thalasso|hydrotherapy|detox|nutrition|nutritional|dietetic|dietetics|dietician|dietitian|longevity|anti aging|antiaging|regenerative|iv therapy|iv drip"),
    ("fitness", "fitness|gym|gyms|sports|sport|athletic|athletics|pilates|crossfit|personal training|swimming|football"),
    ("education", "school|schools|nursery|nurseries|kindergarten|academy|academies|college|university|institute|institutes|education|educational|learning|childhood|preschool|pre school|montessori|tuition|campus"),
    ("occupational", "occupational health|corporate health|employee health|workplace health|labour camp|labor camp|industrial|offshore|aviation medical|marine medical|driving"),
    ("medical_center", "medical centre|medcentre|medicalcentre|medical complex|health centre|healthcare centre|medcare|medi centre|medical polyclinic"),
    ("clinic", "clinic|clinique|kliniek|klinik|mediclinic|medclinic|surgery|surgeries|practice|doctors|doctor|dr|physician|physicians"),
    ("medical_center", "medical|medicine|medicare|medico|healthcare|health care|medi"),
    ("center", "centre|health|care|hub"),
]
# Guesses of the register that are taken over, and kinds by the share of the staff that has such a specialty.
GUESSES = ("hospital", "polyclinic", "pharmacy", "dental", "laboratory", "optical", "medical_center", "clinic", "center")
STAFF_RULES = [
    ("pharmacy", 0.6, "pharmacist|pharmacy technician|pharmaceutical"),
    ("dental", 0.5, "dentist|dental|orthodont|prosthodont|endodont|periodont"),
    ("optical", 0.5, "optometrist|optician|ophthalmic technician|orthoptist"),
    ("laboratory", 0.5, "laboratory (technologist|technician|aide)|medical laboratory|microbiolog|histopatholog|phlebotom"),
    ("diagnostic_center", 0.5, "radiograph|radiolog|sonograph|nuclear medicine|imaging"),
    ("physiotherapy", 0.5, "physiotherapist|physical therap|occupational therapist|chiropract|osteopath|podiatrist|prosthetist|orthotist"),
    ("mental_health", 0.5, "psycholog|psychiatr|speech (therapist|and language)|behavio(?:u)?r|counsell?or"),
    ("aesthetic", 0.5, "aesthetician|beauty therapist|laser hair|cosmetolog|dermatolog"),
    ("alternative", 0.5, "ayurved|homeopath|homoeopath|unani|acupunctur|naturopath|chinese medicine|tcim"),
    ("wellness", 0.5, "dietician|dietitian|nutrition"),
    ("nursing", 0.6, "nurse|midwife|midwifery"),
    ("clinic", 0.5, "general practitioner|family medicine|physician|specialist|consultant|medical (?:resident|intern)"),
]


def facility_types(facilities: DataFrame, staff: DataFrame) -> DataFrame:
    """(facility_id, type, type_source). facilities: facility_id, name, guess; staff: facility_id, specialty, cnt [A10].

    The staff is reduced to one row a facility by conditional sums before it is joined; nothing is collected.
    """
    sums = [F.sum(F.when(F.col("specialty").rlike("(?i)" + p), F.col("cnt")).otherwise(0)).alias(f"s{i}") for i, (_, _, p) in enumerate(STAFF_RULES)]
    per = staff.groupBy("facility_id").agg(F.sum("cnt").alias("total"), *sums)
    words = facility_words(F.coalesce("name", F.lit("")))
    by_name = F.coalesce(*[F.when(words.rlike(f"(?:^| )(?:{p})(?: |$)"), F.lit(t)) for t, p in NAME_RULES])
    guess = F.lower("guess")
    by_guess = F.when(guess.isin(*GUESSES), guess)
    by_staff = F.when(F.col("total") > 0, F.coalesce(*[F.when(F.col(f"s{i}") / F.col("total") >= share, F.lit(t)) for i, (t, share, _) in enumerate(STAFF_RULES)], F.lit("center")))
    joined = facilities.join(per, "facility_id", "left").withColumns({"n": by_name, "g": by_guess, "s": by_staff})
    source = F.when(F.col("n").isNotNull(), "name").when(F.col("g").isNotNull(), "dha_type").when(F.col("s").isNotNull(), "staff").otherwise("unclassified")
    return joined.select("facility_id", F.coalesce("n", "g", "s", F.lit("other")).alias("type"), source.alias("type_source"))


def type_statistics(types: DataFrame) -> DataFrame:
    """[A11] (type, type_source, facilities): facilities of each kind and, apart from that, by what told it; one aggregation over grouping sets."""
    return types.groupingSets([["type"], ["type_source"]], "type", "type_source").agg(F.count(F.lit(1)).alias("facilities"))


def staff_tally(link: DataFrame, people: DataFrame) -> DataFrame:
    """[A10] (facility_id, specialty, cnt) of current people. people: doctor_id, specialty."""
    return link.where("is_current").select("doctor_id", "facility_id").join(people.where("specialty IS NOT NULL"), "doctor_id").groupBy("facility_id", "specialty").agg(F.count(F.lit(1)).alias("cnt"))

