"""Finding personal values in free text (problem 3): names, telephone numbers, e-mail and street addresses, identity numbers.

E-mail addresses and street addresses are found by form, numbers by form and the words before them, names by what stands around
them: titles, roles, labels, verbs of speech; in scripts without capitals by titles, forms of address and labels with a colon. Names of three letters and more
found once in a text are found wherever they recur in it. A word that announces a telephone number counts up to NEAR characters before it within a clause;
nothing else is bounded but by what the standard of e-mail addresses allows and by the words over which a pattern of names can reach at all.
"""

import bisect
import unicodedata
from typing import NamedTuple

import regex

V1 = regex.VERSION1


class Mention(NamedTuple):
    kind: str
    start: int
    end: int


def _words(*lists: str) -> str:
    return "|".join(sorted((regex.escape(w).replace(r"\ ", r"\s+") for x in lists for w in x.split("|")), key=len, reverse=True))


# ---- e-mail -------------------------------------------------------------------------------------------------------
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|arroba|ät)\s?[)\]}>]\s?|\s(?:\(a\)|at(?=\s[a-z0-9-]+\s(?:dot|punkt|punto)\s))\s)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|punkt|punto|point)\s?[)\]}>]\s?|\s(?:dot|punkt|punto)\s)"
_AT_SIGN = regex.compile(r"(?<=[A-Za-z0-9_]\s?)@(?=\s?[A-Za-z0-9])|[(\[{<]\s?(?:at|arroba|ät)\s?[)\]}>]|\(a\)|\sat(?=\s[a-z0-9-]+\s(?:dot|punkt|punto)\s)", regex.I)
EMAIL = regex.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+'-]{{0,63}}[A-Za-z0-9_+-])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9-]*[A-Za-z0-9])+", regex.I)

#: Characters that the standard allows before and after the sign of an e-mail address.
LOCAL, DOMAIN = 64, 255

# ---- addresses ----------------------------------------------------------------------------------------------------
# Kinds of street by language.
_EN = "Street|St|Road|Rd|Avenue|Ave|Av|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Terrace|Ter|Terr|Close|Crescent|Cres|Circle|Cir|Way|Parkway|Pkwy|Highway|Hwy|Row|Mews|Trail|Trl|Alley|Walk|Loop|Plaza|Gardens|Grove|Hill|Quay|Path|Pike|Turnpike|Broadway|Esplanade|Parade|Green|Rise|View"
_PRE = "avenida|avda|av|calle|c/|paseo|plaza|camino|carrera|carretera|travesía|ronda|callejón|rua|travessa|praça|largo|via|viale|piazza|corso|vicolo"
_FR = "rue|avenue|av|boulevard|bd|place|impasse|allée|allées|chemin|route|quai|square|cours|passage|sentier|villa|faubourg"
_CAP = r"(?:\p{Lu}[\p{L}\p{M}'’-]*\.?)"
_NUM = r"\d{1,5}(?:\s?[-/]\s?\d{1,4})?(?:\s?-?[A-Za-z](?![\p{L}\d]))?"
_SUFFIX = "|".join(w for x in _EN.split("|") for w in (x, x.upper()))
_DIR = r"(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West|Old|New|Upper|Lower|Great|Little)\.?\s+)"
ADDRESS = [
    regex.compile(rf"(?<![\p{{L}}\d.,/:#-])\d{{1,5}}(?:-?[A-Z])?,?\s+{_DIR}{{0,2}}(?:{_CAP}\s+){{1,3}}(?:{_SUFFIX})(?![\p{{L}}\d])"),
    regex.compile(rf"(?<![\p{{L}}\d.,/:-])\d{{1,5}}(?:\s?(?:bis|ter|[A-D]))?,?\s+(?i:{_words(_FR)})\s+(?:(?i:de la|de l['’]|des|du|de|d['’])\s*)?{_CAP}(?:[\s-]+(?:(?:de|du|la|des)\s+)?{_CAP}){{0,3}}", V1),
    regex.compile(rf"(?<![\p{{L}}\d])(?i:{_words(_PRE)})\.?\s*(?:(?:de la|de los|de las|del|de|della|delle|dei|do|da|dos|das)\s+)?{_CAP}(?:\s+(?:(?:de|del|la|y)\s+)?{_CAP}){{0,3}},?\s+(?:n[.º°o]+\s*)?\d{{1,5}}", V1),
    regex.compile(rf"(?<![\p{{L}}\d-])\p{{Lu}}[\p{{L}}-]*(?i:straße|strasse|str\.|str|gasse|weg|platz|allee|ring|ufer|damm|steig|pfad|chaussee|markt|wall|laan|straat|gade|vej|gatan|vägen)\s+\d{{1,4}}\s?[a-z]?(?![\p{{L}}\d])", V1),
    regex.compile(rf"(?<![\p{{L}}\d-])(?:{_CAP}[\s-]+){{1,3}}(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ring|Ufer|Damm)\s+\d{{1,4}}\s?[a-z]?(?![\p{{L}}\d])"),
    regex.compile(r"(?<![\p{L}])(?:ул\.|улица|пр\.|проспект|пер\.|переулок|наб\.|бульвар)\s+\p{Lu}[\p{L}-]+(?:\s+\p{Lu}?[\p{L}-]+)?,?\s+(?:д\.|дом)?\s*\d{1,4}"),
    regex.compile(r"(?<![\p{L}])(?:شارع|طريق|حي)\s+[\p{Arabic}\s]{2,30}?\s*\d{1,5}"),
    regex.compile(r"[\p{Han}]{2,6}(?:路|街|大道|巷)\d{1,5}(?:号|號)|\p{Han}{1,4}(?:都|道|府|県)?\p{Han}{1,6}(?:市|区|町|村)\p{Han}{0,6}\d{1,4}(?:丁目|番地|[-−]\d{1,4})"),
]

# ---- numbers ------------------------------------------------------------------------------------------------------
# Words before a number that make it an identity number, a telephone number, or neither, by language.
_ID_WORDS = _words(
    "mrn|medical record number|medical record no|medical record|record number|record no|record|chart number|chart no|chart|patient id|patient number|hospital number|case number|account number|account no|"
    "ssn|ss no|social security number|social security no|social security|passport number|passport no|passport|policy number|policy no|policy|member id|member number|member no|insurance number|insurance no|insurance id|insurance|"
    "subscriber id|patient's id|id|group number|nhs number|nhs no|medicare number|medicare|medicaid|license number|licence number|driver license|identity number|id number|id no|identity card|identification",
    "versichertennummer|versicherungsnummer|versicherten-nr|krankenversichertennummer|patientennummer|fallnummer|aktenzeichen|ausweisnummer|reisepass|personalausweis|pass-nr",
    "numéro de dossier|dossier n°|dossier|numéro de sécurité sociale|sécurité sociale|passeport|carte vitale|nir",
    "historia clínica|número de historia|expediente|dni|nie|nif|pasaporte|seguro social|seguridad social|tarjeta sanitaria|póliza",
    "полис|паспорт|снилс|история болезни|номер карты|병록번호|病历号|住院号|身份证号|身份证|医保卡号|护照号|護照|護照號|カルテ番号|患者番号|保険証番号|旅券番号|パスポート|รหัสผู้ป่วย|เลขประจำตัว|हाज़िरी संख्या|पहचान संख्या|आधार|रोगी संख्या|रिकॉर्ड संख्या|رقم الملف|رقم الهوية|رقم الجواز|جواز السفر|رقم التأمين",
)
_PHONE_WORDS = _words(
    "call|calls|called|calling|callback number|callback|call back|phone|telephone|tel|mobile|cell|fax|pager|reach|reached at|reachable at|message on|message at|text|contact number|number is|ring|dial|hotline|voicemail",
    "telefon|tel.|handy|mobil|erreichbar unter|bitte unter|rückruf|anruf|unter|téléphone|tél|portable|joindre|appeler|joindre la famille au|au|teléfono|telf|tfno|móvil|llamar al|llamar|телефон|тел|звонить|моб|по номеру",
    "电话|联系电话|手机|致电|电话为|連絡先は|連絡先|電話|携帯|फ़ोन|फोन|मोबाइल|दूरभाष|هاتف|جوال|اتصل|الهاتف|على الرقم|โทร|โทรศัพท์|เบอร์|ติดต่อ|ติดต่อญาติได้ที่",
)
_OTHER_WORDS = _words("lot|model|firmware|batch|serial|version|rev|ref|second|device|article|item|order|protocol|protocole|room|bed|station|ward|haus|zimmer|dose|lots|study|trial|page|score|sample|specimen|code|icd|cpt|version")
ID_VALUE = regex.compile(r"(?<![\p{Latin}\d])(?=(?:[A-Za-z./ -]{0,5}\d){4})(?:[A-Za-z]{1,3}|[A-Z]{1,3}[-.])?\d(?:[-. /]?\d)*(?:[-. ]?[A-Za-z](?![A-Za-z]))?")
SSN = regex.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_SEP = r"(?:\s?[-./–]\s?|\s)?"
PHONE = regex.compile(rf"(?<![\p{{Latin}}\d.,/#@+-])(?:\+\s?\d{{1,3}}{_SEP}|00\d{{2}}{_SEP}|\(\+?\d{{1,4}}\){_SEP}|1{_SEP}(?=\(?\d{{3}}))?(?:\(\d{{1,5}}\){_SEP})?\d{{1,5}}(?:{_SEP}\d{{1,5}}){{0,5}}(?![\p{{Latin}}\d]|[.,/]\d|[-–]\d)")
#: Characters within a clause between a word that announces a telephone number and the number.
NEAR = 45
_PHONE_BEFORE = regex.compile(rf"(?r)(?:(?<![\p{{L}}])(?:{_PHONE_WORDS}))[^\d.;!?。]{{0,{NEAR}}}$|(?:{_words('tel|fax|ph|tél|telf|тел')})[.:]?\s*$", regex.I | V1)
_ID_BEFORE = regex.compile(rf"(?r)(?<![\p{{L}}])(?:{_ID_WORDS})(?:\s*(?:no|nr|num|number|id|n°|nº|№|#)\b\.?)?\s*(?:[.:#=]|is|was|lautet|es|ist|est|为|為|は|：|号)*\s*$", regex.I | V1)
_OTHER_BEFORE = regex.compile(rf"(?r)(?<![\p{{L}}])(?:{_OTHER_WORDS})[\s:.#]*(?:no|number|nr)?[\s:.#]*$", regex.I | V1)
#: Forms that are telephone numbers wherever they stand.
_PHONE_FORM = regex.compile(r"\+\s?\d[\d\s().–/-]{6,}\d|00\d{2}[\s.-]\d[\d\s.-]{5,}\d|\(\d{2,5}\)\s?\d{2,4}[\s.–/-]?\d{3,5}|(?:1[-. ])?\d{3}([-. ])\d{3}\1\d{4}|0\d([ .-])\d\d\2\d\d\2\d\d\2\d\d")

# ---- names --------------------------------------------------------------------------------------------------------
# Titles, roles, relations and words that are not names although they stand where names do, by language.
_TITLE_DOT = "dr|mr|mrs|ms|mx|prof|rev|st|sr|sra|srta|dra|m|mm|hr|fr|dott|sig|drs|ing|doc|д-р|проф|г-н|г-жа|др"
_TITLE = "doctor|mister|missus|miss|professor|mme|mlle|madame|monsieur|mademoiselle|me|frau|herr|herrn|señor|señora|señorita|don|doña|doctora|nurse|sister mary|sir|lady|lord|dame|docteur|professeur|доктор|профессор|господин|госпожа"
_ROLE = "interpreter|translator|attending|surgeon|physician|therapist|neurologist|cardiologist|radiologist|social worker|technician|pharmacist|resident|fellow|consultant|counselor|chaplain|driver|caretaker|coordinator|dietitian|midwife|paramedic|officer|witness|guardian|attorney|infirmière|infirmier|enfermera|enfermero|pfleger|schwester|krankenschwester|dolmetscher|dolmetscherin"
_RELATION = "mother|father|sister|brother|wife|husband|son|daughter|cousin|niece|nephew|aunt|uncle|grandmother|grandfather|grandson|granddaughter|neighbor|neighbour|roommate|partner|caregiver|caretaker|friend|fiance|fiancée|spouse|girlfriend|boyfriend|stepmother|stepfather|stepson|stepdaughter|case manager|landlord|coworker|colleague|teacher|boss|employer|parent|guardian|mutter|vater|schwester|bruder|ehefrau|ehemann|tochter|sohn|nachbarin|nachbar|mère|père|sœur|frère|épouse|époux|femme|mari|fille|fils|voisin|voisine|madre|padre|hermana|hermano|esposa|esposo|marido|hija|hijo|vecina|vecino|tía|tío"
_NOT = frozenset(
    """the a an and or of on in at by to for with from as is was were are has had have he she they it we you i his her their our its this that these those who which what when where why how if no not yes
    call patient patients pt mother father sister brother wife husband son daughter cousin niece nephew neighbor roommate partner caregiver friend family staff team nurse doctor dr mr mrs ms prof md do rn np pa phd mph
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday today yesterday tomorrow
    unit ward wing house center centre hospital clinic hospice annex infirmary rehabilitation pavilion department emergency room day intensive care medical health memory movement stroke infusion outpatient
    mri ct eeg emg ekg ecg mrn ssn dob tel fax name unit attending addr address email e-mail phone contact per re plan exam results assessment impression medications history addendum interval social
    will read agrees checked called came says said asks asked noticed reports denies takes started stopped could would should may might speech gait pain weight blood visual power score serum appetite sleep
    der die das und von zu im am mit den dem ein eine la el los las un una le les des du et que en con por para su sus sie er ihr ihre il elle une on ce cette med medical records desk telephone review all both left right
    other another someone nobody everyone alone again about after before during without still now new old next last first second third police insurance insurer pharmacy results copies fax message same
    walks woke lives drinks sleeps reflexes imaging reviewed discussed transferred previously former tolerates increase missed compared witnesses why there referred signed spoke seen home moved left please device
    therapy services nursing pathology radiology neurology cardiology oncology psychiatry surgery laboratory consult physical occupational work""".split()
)
_GIVEN = r"\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]\p{Lu}?[\p{Ll}\p{M}]+)*"
_UP = r"\p{Lu}{2,}(?:[-'’]\p{Lu}{2,})*"
_ONE = rf"(?:{_GIVEN}|{_UP})"
_INI = r"\p{Lu}\."
_PART = r"(?:van|von|de|del|della|di|da|dos|bin|ibn|al|el|le|la|ter|ten|der|den|zu|af)"
_S = r"(?:[^\S\n]{1,2}|[^\S\n]?\n[^\S\n]?(?=\S))"
_FULL = rf"(?:{_INI}\s?){{0,2}}{_ONE}(?:{_S}{_INI})?(?:{_S}(?:{_PART}{_S}){{0,2}}{_ONE}){{0,2}}"
_PAIR = rf"{_ONE}(?:{_S}{_ONE})?,{_S}?{_ONE}(?:{_S}{_INI})?"
_TWO = rf"{_ONE}(?:{_S}{_INI})?{_S}(?:{_PART}{_S}){{0,2}}{_ONE}"
_B = r"(?<![\p{L}\p{M}'’])"
_REL = _words(_RELATION)
_SAY = _words("says|said|reports|reported|states|stated|recalls|recalled|remembers|thinks|believes|asks|asked|answered|mentions|mentioned|noted|noticed|describes|described|confirms|confirmed|explains|explained|denies|denied|admits|complains|complained|feels|wrote|brought|drove|called|came|arrived|accompanied|visited|insists|agreed")

_SCAFFOLD = [
    # labels
    (rf"{_B}(?i:patient name|patient's name|full name|name of patient|next of kin|emergency contact|name|patientin|patient|paciente|nombre|nom|имя|фио|пациент)(?:\s*[:=]|\s+(?i:is|was|ist|es|est))\s*(?P<n>{_PAIR}|{_FULL})", "label"),
    (rf"{_B}(?i:patient name|emergency contact|next of kin)\s+(?P<n>{_PAIR}|{_FULL})", "label"),
    (rf"{_B}(?i:attending|provider|physician|surgeon|author|dictated by|cosigned by|signed by|referring|pcp|consultant|resident|nurse)\s*:\s*(?:(?i:dr|prof)\.\s*)?(?P<n>{_FULL})", "label"),
    # verbs and prepositions that take a person
    (rf"{_B}(?i:referred|signed electronically|electronically signed|signed|dictated|cosigned|co-signed|reviewed|seen|examined|accompanied|brought in|prescribed|ordered|performed|transcribed|verified|witnessed|interpreted|evaluated|followed|supervised)\s+by\s+(?P<n>{_FULL})", "by"),
    (rf"{_B}(?i:spoke with|spoken with|talked to|talked with|discussed with|discussed at length w/|discussed at length with|discussed w/|met with|according to|copies were sent to|copy sent to|copy to|cc|forwarded to|letter to|addressed to|seen with|together with|visited by|married to|lives with|care of|contacted|informed|notified|texted|phoned)\s*:?\s+(?P<n>{_FULL})", "by"),
    (rf"{_B}(?:Per|per|PER)\s+(?P<n>{_FULL})(?=,|\s+the\b)", "by"),
    # relations
    (rf"{_B}(?i:{_REL}),\s+(?P<n>{_FULL}),", "kin"),
    (rf"{_B}(?i:her|his|their|the|my|a|ihre?|seine?|su|sa|son)\s+(?i:{_REL})\s+(?P<n>{_FULL})(?=\s+(?:\p{{Ll}}|\p{{Lu}}{{3,}}))", "kin"),
    (rf"{_B}(?P<n>{_FULL})\s+\((?i:(?:the|her|his)?\s*(?:{_REL}))\)", "kin"),
    (rf"{_B}(?P<n>{_FULL}),\s+(?i:an?|the|her|his)\s+(?i:{_REL})\b", "kin"),
    (rf"{_B}(?P<n>{_FULL}),?\s+(?:MD|M\.D\.|DO|RN|NP|PA-C|PhD|Ph\.D\.|MPH|FACP)\b", "by"),
    (rf"{_B}(?P<n>{_TWO}|{_GIVEN})['’]s\s+(?i:{_REL})\b", "kin"),
    (rf"{_B}(?i:пациент|пациентка|больной|больная|patient|patientin|paciente)\s+(?P<n>{_TWO})", "kin"),
    (rf":\s+(?P<n>{_TWO}),\s+\d{{1,3}}\s?(?:[MF]\b|(?i:yo|y/o|years?|yrs?)\b)", "age"),
    # sentence beginnings
    (rf"(?<=^|[.!?]\s{{1,4}}|\n\s*)(?P<n>{_TWO})\s+(?:{_SAY})\b", "say"),
    (rf"{_B}(?P<n>{_TWO}|{_ONE})\s+(?:is|was|IS|WAS)\s+(?:an?|AN?)\s+\d{{1,3}}[\s-]*(?i:year|yr|y/o|yo|month|mo)", "age"),
    (rf"(?:(?<=^|[.!?。।»”\"]\s{{0,4}}|\n\s*)|{_B})(?P<n>{_TWO}|{_ONE})\s+(?:{_SAY})\s+(?:that|to|he|she|no)\b", "say"),
    (rf"{_B}(?i:{_words(_ROLE)})\s+(?P<n>{_FULL})", "role"),
    (rf"{_B}(?i:{_words(_TITLE)})\s+(?:(?i:dr|prof)\.\s*)?(?:(?i:med)\.\s*)?(?P<n>{_FULL})", "title"),
    # title + name; the name may be in lower case after a title with a dot
    (rf"{_B}(?i:{_words(_TITLE_DOT)})(?:\.\s*|\s+)(?:(?i:med|phil|rer\.?\s?nat|dent|jur|ing|h\.?c)\.\s*)*(?P<n>{_FULL})", "title"),
    (rf"{_B}(?i:mr|mrs|ms|mx|dr|prof)\.\s+(?P<n>\p{{Ll}}{{4,}}(?:\s\p{{Ll}}{{4,}}(?=\s(?:came|called|is|was|will|has)\b))?)", "lower"),
]
# Family names, titles, labels and words that no name begins with, in scripts without capitals.
_ZH = "王李张刘陈杨黄赵周吴徐孙马朱胡郭何林罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆戴贾韦夏邱侯邹熊孟秦阎薛尹段雷黎史陶贺顾郝龚邵钱严赖覃洪莫孔張劉陳楊黃趙吳孫馬羅鄭謝許鄧馮韓蕭葉蔣蘇呂盧鍾譚陸賈賀顧龔錢嚴賴"
_KO = "김이박최정강조윤장임한오서신권황안송류홍고문양손배백허유남심노곽성차주우구민진엄채원천방공"
_HANGUL = rf"[{_KO}]\p{{Hangul}}{{1,2}}"
_JA_NOT = r"(?:患者|看護|医師|担当|主治|家族|皆|奥|娘|息子|母|父|兄|姉|弟|妹|夫|妻|先|ご|お|同|貴|当|医|本人|技師|介護|職員|利用|子|孫|叔|伯|祖)"
_AR_NOT = r"(?!ال|من\s|في\s|على\s|إلى\s|أن\s|قد\s|لا\s)"
_HI_NOT = r"(?!(?:ने|को|से|के|का|की|द्वारा|पर|में|और|है|हैं|था|थी|साहब|जी|तथा|या|नहीं)(?![\p{Devanagari}]))"
_TH_NOT = r"(?!หมอ|พ่อ|แม่|ลุง|ป้า|น้า|ยาย|ตา|ปู่|ย่า|ภาพ|สมบัติ|ลักษณะ|ประโยชน์|ค่า|ครู|พยาบาล|ผู้|กำนัน|จ้าง)"
_CASELESS = [
    # labels with a colon
    rf"(?:患者姓名|病人姓名|姓名|联系人|聯絡人|家属姓名|主治医师|主治醫師|医师签名|医生签名|签名|患者氏名|氏名|担当医|主治医|記載者|家族氏名)\s*[:：]\s*(?P<n>[{_ZH}]\p{{Han}}{{1,3}}|\p{{Han}}{{2,4}}\s?\p{{Han}}{{0,3}}|\p{{Katakana}}[\p{{Katakana}}ー・]+)",
    rf"(?:환자\s?이름|환자명|환자\s?성명|성명|이름|보호자명|담당의|주치의)\s*[:：]\s*(?P<n>{_HANGUL})",
    rf"(?:اسم المريضة?|الاسم|اسم الطبيب|الطبيب المعالج|اسم المرافق)\s*[:：]\s*(?P<n>{_AR_NOT}[\p{{Arabic}}--\p{{N}}]+(?:\s[\p{{Arabic}}--\p{{N}}]+)?)",
    rf"(?:रोगी का नाम|मरीज का नाम|मरीज़ का नाम|चिकित्सक का नाम|नाम)\s*[:：]\s*(?P<n>{_HI_NOT}[\p{{Devanagari}}--\p{{N}}]+(?:\s{_HI_NOT}[\p{{Devanagari}}--\p{{N}}]+)?)",
    rf"(?:ชื่อผู้ป่วย|ชื่อ-สกุล|ชื่อแพทย์|ชื่อญาติ|ชื่อ)\s*[:：]\s*(?P<n>[\p{{Thai}}--\p{{N}}]{{2,}}(?:\s[\p{{Thai}}--\p{{N}}]{{2,}})?)",
    r"(?:שם החולה|שם המטופל|שם)\s*[:：]\s*(?P<n>\p{Hebrew}{2,}(?:\s\p{Hebrew}{2,})?)",
    # titles and forms of address, behind the name or before it
    rf"(?P<n>(?<!\p{{Han}})[{_ZH}]\p{{Han}}{{0,2}}?)(?:先生|女士|小姐|太太|医生|醫生|大夫|教授|护士长|護士)",
    rf"(?<![\p{{Han}}\p{{Hiragana}}\p{{Katakana}}ー])(?!{_JA_NOT})(?P<n>\p{{Han}}{{1,3}}(?:\s?\p{{Han}}{{1,3}})?|\p{{Katakana}}[\p{{Katakana}}ー・]+)(?:さん|様(?!子|々|式|態)|氏(?!名))",
    rf"(?<!\p{{Hangul}})(?P<n>{_HANGUL})\s?(?:씨|님|선생님|교수님|과장님)(?!\p{{Hangul}}{{3}})",
    rf"(?<!\p{{Arabic}})(?:السيد|السيدة|الآنسة|الدكتور|الدكتورة)\s+(?P<n>{_AR_NOT}[\p{{Arabic}}--\p{{N}}]+)",
    rf"(?<![\p{{Devanagari}}])(?:श्रीमती|श्री|सुश्री|कुमारी|डॉ\.)\s*(?P<n>{_HI_NOT}[\p{{Devanagari}}--\p{{N}}]+(?:\s{_HI_NOT}[\p{{Devanagari}}--\p{{N}}]+(?=\s(?:ने|को|से|के|का|की|द्वारा)\s))?)",
    rf"(?<!\p{{Thai}})(?:นางสาว|นาย|นาง|คุณ|นพ\.|พญ\.|น\.ส\.)\s?{_TH_NOT}(?P<n>[\p{{Thai}}--\p{{N}}]{{2,20}})(?!\p{{Thai}})",
    r"(?<!\p{Hebrew})(?:מר|גב['׳]|גברת|ד[\"״]ר|פרופ['׳])\s+(?P<n>\p{Hebrew}{2,}(?:\s\p{Hebrew}{2,}(?=[\s,.]))?)",
]
_NO_CAPITALS = regex.compile(r"[\p{Han}\p{Katakana}\p{Hangul}\p{Arabic}\p{Devanagari}\p{Thai}\p{Hebrew}]")
CASELESS = [regex.compile(p, V1) for p in _CASELESS]
_UNSPACED = regex.compile(r"[\p{Han}\p{Hangul}]+")
SCAFFOLD = [(regex.compile(p.replace(" ", r"\s+"), V1), why) for p, why in _SCAFFOLD]
AND_MORE = regex.compile(rf"\s+(?:and|und|et|y|&)\s+(?=(?:(?i:{_words(_TITLE_DOT)})\.\s*)(?:{_FULL}))|\s+(?:and|&)\s+(?P<n>{_TWO})", V1)
_EPONYM = regex.compile(r"\s+(?:['’]s\s+)?(?i:disease|syndrome|sign|test|reflex|scale|palsy|paresis|bodies|phenomenon|criteria|score|maneuver|chorea|index|classification|hospital|clinic|center|centre|house|wing|ward|unit|hospice|infirmary|annex|rehabilitation|university|institute|school|pharmacy|foundation|street|st|road|avenue)\b")
_INSTITUTION = regex.compile(r"(?i:\b(?:unit|ward|wing|pavilion|house|hospital|clinic|at|behind|from)\s+)$")


_NAME_WORD, _LONG_WORD = regex.compile(r"[\p{L}\p{M}'’-]+\.?"), regex.compile(r"[\p{L}\p{M}'’-]{3,}")
_INITIAL, _SMALL, _DIGIT = regex.compile(_INI), regex.compile(r"\p{Ll}"), regex.compile(r"\d")
_POSSESSIVE, _THREE_FOUR = regex.compile(r"['’][sS]$"), regex.compile(r"\d{3}[-. /]+\d{4}")


def _bare(word: str) -> str:
    return _POSSESSIVE.sub("", word.rstrip(".")).lower()


def _fits(text: str, a: int, b: int, why: str) -> tuple[int, int] | None:
    """The part of text[a:b] that may be a name, without words that are none at either side."""
    words = [(m.start() + a, m.end() + a, m[0]) for m in _NAME_WORD.finditer(text[a:b])]
    bare = _bare
    upper = [w for *_, w in words if len(w) > 2 - (why in ("title", "label"))]
    if words and bare(words[0][2]) in _NOT and not _INITIAL.fullmatch(words[0][2]):
        return None
    end = len(words)
    for k, (_, _, w) in enumerate(words):
        if bare(w) in _NOT and not _INITIAL.fullmatch(w):
            end = k
            break
    words = words[:end]
    while words and _INITIAL.fullmatch(words[-1][2]):
        words.pop()
    if not words or not upper or all(len(bare(w)) < 2 for *_, w in words):
        return None
    a, b = words[0][0], words[-1][1]
    if why in ("kin", "say", "age") and text[a:b].isupper() and len(text[a:b]) > 3 and not _SMALL.search(text[max(0, a - 12) : a] + text[b : b + 12]):
        return None  # within a line in capitals nothing tells a name from a word
    poss = _POSSESSIVE.search(text[a:b])
    b -= len(poss[0]) if poss else 0
    if _EPONYM.match(text[b : b + 20]) and why not in ("title", "label", "lower") or _INSTITUTION.search(text[max(0, a - 12) : a]) and why in ("say",):
        return None
    return a, b


#: The last word of whatever may stand before a name in SCAFFOLD.
_CUES = frozenset(
    [w.split()[-1] for x in (_TITLE_DOT, _TITLE, _ROLE, _RELATION) for w in x.split("|")]
    + "by with to is was name contact kin attending provider physician surgeon author referring pcp consultant resident nurse cc per contacted informed notified texted phoned w of med phil nat dent jur ing and patient paciente nombre nom имя фио пациент patientin ist es est больной больная".split()
)
_LOWER_TITLE = regex.compile(r"(?<![\p{L}])(?i:mr|mrs|ms|mx|dr|prof)\.\s+\p{Ll}")
_CAPITAL = regex.compile(r"(?<![\p{L}\p{M}'’])\p{Lu}[\p{L}\p{M}'’-]*")
_BEHIND = regex.compile(rf"[\p{{L}}-]+['’]s\s+(?i:{_REL})\b|(?:[\p{{L}}'’-]+\.?(?:\s+|,\s*)){{1,3}}(?:(?:{_SAY})\s|(?i:is|was)\s+an?\s+\d|\(|(?i:an?|the|her|his)\s|\d{{1,3}}\s?(?:[MFy]|year)|(?:MD|M\.D|DO|RN|NP|PA|PhD|Ph\.D|MPH|FACP)\b)", V1)
#: Words before and after a capital word over which a pattern of SCAFFOLD may reach.
BACK, AHEAD = 10, 16
_BLANK = regex.compile(r"\s+")
_LAST_WORD = regex.compile(r"(?r)([\p{L}-]+)[\s.,:=/(]*$")


def _near_cues(text: str) -> list[tuple[int, int]]:
    """Where names may be: stretches around capital words that a cue stands before or behind, and around titles before a word in lower case."""
    out: list[tuple[int, int]] = []
    at = [m.start() for m in _LOWER_TITLE.finditer(text)]
    for m in _CAPITAL.finditer(text):
        a = m.start()
        if m[0].lower() in _NOT and not (len(m[0]) == 1 and text[a + 1 : a + 2] == "."):
            continue
        last = _LAST_WORD.match(text, 0, a)
        if last and (w := last[1].lower()) and (w in _CUES or w.rpartition("-")[2] in _CUES) or _BEHIND.match(text, a):
            at.append(a)
    if not at:
        return out
    blanks = [m.start() for m in _BLANK.finditer(text)]
    for a in sorted(at):
        k = bisect.bisect_left(blanks, a)
        lo, hi = blanks[k - BACK] if k >= BACK else 0, blanks[k + AHEAD] if k + AHEAD < len(blanks) else len(text)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def find(text: str | None) -> list[Mention]:
    """Mentions of personal values in a text, in order, without overlaps."""
    if not text or text.isspace():
        return []
    found: list[Mention] = []
    names: list[Mention] = []
    taken = bytearray(len(text))  # what mentions cover

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def take(to: list[Mention], kind: str, a: int, b: int) -> None:
        to.append(Mention(kind, a, b))
        taken[a:b] = b"\x01" * (b - a)

    for at in _AT_SIGN.finditer(text):  # the costly pattern runs only around what may be the sign within an address
        if found and at.start() < found[-1].end:
            continue
        m = next((m for m in EMAIL.finditer(text, max(0, at.start() - LOCAL - 1), at.end() + DOMAIN) if m.start() < at.start() < m.end()), None)
        if m and free(*m.span()):
            take(found, "email", *m.span())
    digits = _DIGIT.search(text) is not None
    if digits:
        for p in ADDRESS:
            for m in p.finditer(text):
                a, b = m.start(), m.end() - m[0].endswith(".")
                if free(a, b):
                    take(found, "address", a, b)
        for v in ID_VALUE.finditer(text):
            if _ID_BEFORE.match(text, 0, v.start()) and free(*v.span()):
                take(found, "id_number", *v.span())
        for m in SSN.finditer(text):
            if free(*m.span()) and not _PHONE_BEFORE.match(text, 0, m.start()):
                take(found, "id_number", *m.span())
        for m in PHONE.finditer(text):
            a, b = m.span()
            n = sum(c.isdigit() for c in m[0])
            if not 7 <= n <= 15 or not free(a, b):
                continue
            if _OTHER_BEFORE.match(text, 0, a) or _ID_BEFORE.match(text, 0, a):
                continue
            cue = _PHONE_BEFORE.match(text, 0, a) is not None
            form = _PHONE_FORM.fullmatch(m[0]) is not None
            if cue and (n >= 9 or _THREE_FOUR.search(m[0]) or "(" in m[0]) or form:
                take(found, "phone", a, b)
    near = _near_cues(text)
    for p, why in SCAFFOLD:
        for m in (m for a, b in near for m in p.finditer(text, a, b)):
            if why == "lower" and m["n"].split()[0] in _NOT:
                continue
            got = _fits(text, *m.span("n"), why)
            if got is None or not free(*got):
                continue
            take(names, "name", *got)
            more = AND_MORE.match(text, got[1])
            if more and more["n"] and why == "by":
                other = _fits(text, *more.span("n"), why)
                if other and free(*other):
                    take(names, "name", *other)
    if _NO_CAPITALS.search(text):
        for p in CASELESS:
            for m in p.finditer(text):
                if free(*m.span("n")):
                    take(names, "name", *m.span("n"))
        for w in {text[m.start : m.end] for m in names if m.end - m.start > 2 and _UNSPACED.fullmatch(text, m.start, m.end)}:  # in scripts without blanks nothing need stand around a name
            at = text.find(w)
            while at >= 0:
                if free(at, at + len(w)):
                    take(names, "name", at, at + len(w))
                at = text.find(w, at + len(w))
    known = {w for s in names for w in _LONG_WORD.findall(text[s.start : s.end]) if w.lower() not in _NOT}
    for w in sorted(known, key=lambda w: (-len(w), w)):
        at = text.find(w)
        while at >= 0:
            end = at + len(w)
            before, after = text[at - 1 : at], text[end : end + 1]
            alone = not (before.isalpha() or after.isalpha() or before and before in "@._%+'’-" or after and after in "@_-" or after and unicodedata.combining(after))
            if alone and free(at, end) and not _EPONYM.match(text[end : end + 20]):
                take(names, "name", at, end)
            at = text.find(w, end)
    merged: list[Mention] = []
    for s in sorted(names, key=lambda s: s.start):  # neighbours that only a blank parts are one mention
        if merged and s.start - merged[-1].end < 3 and text[merged[-1].end : s.start].isspace():
            merged[-1] = Mention("name", merged[-1].start, s.end)
        else:
            merged.append(s)
    return sorted(found + merged, key=lambda s: s.start)
