"""Fixed values that results depend on: word lists, sounds and patterns, as plain text."""

from __future__ import annotations

# Legal forms removed from names of organisations wherever they stand, in this order.
LEGAL_FORMS = (
    "주식회사", "(주)", "㈜", "재단법인", "사단법인", "산학협력단", "co., ltd.", "co. ltd", "co.,ltd", "ltd.", "ltd", "inc.", "inc",
    "corp.", "corporation", "gmbh", "llc", "univ.",
)
# Abbreviations and what they stand for, a meaning a line.
ABBREVIATIONS = {
    "inst": "institute", "institut": "institute", "institutes": "institute",
    "tech": "technology", "technol": "technology", "technologies": "technology",
    "univ": "university", "universities": "university",
    "sci": "science", "sciences": "science",
    "res": "research",
    "corp": "corporation",
    "elec": "electric", "elect": "electric", "electr": "electric",
    "electron": "electronics",
    "ind": "industrial", "indust": "industrial", "industries": "industrial", "industry": "industrial",
    "natl": "national", "nat": "national",
    "acad": "academy",
    "found": "foundation",
    "mfg": "manufacturing",
    "eng": "engineering", "engng": "engineering",
    "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory",
    "dept": "department",
    "intl": "international", "int": "international",
    "telecom": "telecommunications", "telecommun": "telecommunications",
    "chem": "chemical",
    "mech": "mechanical",
    "med": "medical",
    "hosp": "hospital",
    "assoc": "association",
    "soc": "society",
    "adv": "advanced",
    "mat": "materials", "mater": "materials",
    "sys": "systems", "syst": "systems",
}
# Words that name no organisation.
STOP = (
    "of", "and", "the", "for", "de", "a", "an", "at", "in", "co", "ltd", "inc", "corp", "corporation", "gmbh", "llc",
    "plc", "ag", "kk", "sa", "spa", "bv", "nv", "pte", "pty", "limited", "company", "주식회사", "주", "유한회사", "재단법인",
    "사단법인", "산학협력단", "rdb", "r", "d", "b",
)
# Words that only adorn a name.
DECOR = (
    "south", "north", "korea", "korean", "republic", "japan", "china", "usa", "us", "uk", "germany", "france",
    "india", "taiwan", "europe", "asia", "global", "international", "group", "holdings", "worldwide", "united",
    "states", "america", "american", "kingdom", "netherlands", "switzerland", "sweden", "italy", "spain", "canada",
    "australia", "israel", "singapore", "brazil", "mexico", "russia", "poland", "austria", "belgium", "denmark",
    "norway", "finland", "ireland", "development",
)
# Words that an acronym skips.
SKIPPED = (
    "of", "and", "the", "for", "de", "&",
)
# Legal words left out when a name is written in full.
LEGAL_WORDS = (
    "co", "ltd", "inc", "corp", "corporation", "gmbh", "llc", "plc", "limited", "company",
)
# Suffixes under which neighbours are different organisations.
PUBLIC_SUFFIXES = (
    "ac.kr", "co.kr", "or.kr", "re.kr", "go.kr", "ne.kr", "pe.kr", "edu", "com", "org", "net", "gov", "ac.uk",
    "co.uk", "ac.jp", "co.jp", "or.jp", "edu.cn", "com.cn", "ac.cn", "edu.au", "com.au", "edu.tw", "ac.in", "co.in",
    "de", "fr", "it", "es", "nl", "ch", "at", "be", "se", "dk", "no", "fi", "kr", "jp", "cn", "tw", "uk", "ca", "au",
    "eu",
)
# Words by which a description shows an organisation.
ORG_CUES = (
    "compan", "corporat", "enterprise", "manufactur", "university", "institute", "research", "laborator",
    "organi[sz]ation", "agency", "hospital", "foundation", "school", "college", "academy", "conglomerate", "business",
    "firm",
)

# Fixed values of the romanisation: the sounds at each place of a syllable block, in the order of the Unicode block.
INITIALS = (
    "g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h",
)
MEDIALS = (
    "a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu",
    "ui", "i",
)
FINALS = (
    "", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t",
    "t", "k", "t", "p", "t",
)
# The spellings in use for some of the sounds; any other is spelled as it is.
INITIAL_SPELLINGS = {
    "g": ("g", "k"),
    "d": ("d", "t"),
    "b": ("b", "p"),
    "j": ("j", "ch"),
    "r": ("r", "l"),
    "s": ("s", "sh"),
}
MEDIAL_SPELLINGS = {
    "eo": ("eo", "u", "ou", "o"),
    "eu": ("eu", "u"),
    "u": ("u", "oo", "woo"),
    "ae": ("ae", "ai"),
    "yeo": ("yeo", "you", "yu", "yo"),
    "i": ("i", "ee"),
    "ui": ("ui", "ee"),
    "yu": ("yu", "you", "yoo"),
    "a": ("a", "ah"),
}
FINAL_SPELLINGS = {
    "k": ("k", "g"),
    "p": ("p", "b"),
    "l": ("l", "r"),
}
# Surnames and the spellings in use for them, the usual one first.
SURNAMES = {
    "김": ("Kim", "Gim"),
    "이": ("Lee", "Yi", "Rhee", "Li"),
    "박": ("Park", "Pak", "Bak"),
    "최": ("Choi", "Choe"),
    "정": ("Jung", "Jeong", "Chung", "Joung"),
    "강": ("Kang", "Gang"),
    "조": ("Cho", "Jo", "Joe"),
    "윤": ("Yoon", "Yun"),
    "장": ("Jang", "Chang"),
    "임": ("Lim", "Im", "Rim"),
    "한": ("Han",),
    "오": ("Oh", "O"),
    "서": ("Seo", "Suh", "Su"),
    "신": ("Shin", "Sin"),
    "권": ("Kwon", "Gwon", "Kweon"),
    "황": ("Hwang", "Whang"),
    "안": ("Ahn", "An"),
    "송": ("Song",),
    "류": ("Ryu", "Yoo", "Ryoo"),
    "전": ("Jeon", "Jun", "Chun", "Jeun"),
    "홍": ("Hong",),
    "고": ("Ko", "Go", "Koh"),
    "문": ("Moon", "Mun"),
    "양": ("Yang",),
    "손": ("Son", "Sohn"),
    "배": ("Bae", "Pae"),
    "백": ("Baek", "Paik", "Back"),
    "허": ("Heo", "Huh", "Hur"),
    "유": ("Yoo", "Yu", "You"),
    "남": ("Nam",),
    "심": ("Shim", "Sim"),
    "노": ("Noh", "Roh", "No"),
    "하": ("Ha",),
    "곽": ("Kwak", "Gwak"),
    "성": ("Sung", "Seong"),
    "차": ("Cha",),
    "주": ("Joo", "Ju", "Chu"),
    "우": ("Woo", "U"),
    "구": ("Koo", "Ku", "Gu"),
    "민": ("Min",),
    "나": ("Na", "Ra"),
    "진": ("Jin", "Chin"),
    "지": ("Ji", "Chi"),
    "엄": ("Um", "Eom", "Uhm"),
    "채": ("Chae",),
    "원": ("Won",),
    "천": ("Chun", "Cheon"),
    "방": ("Bang", "Pang"),
    "공": ("Kong", "Gong"),
    "현": ("Hyun", "Hyeon"),
    "함": ("Ham",),
    "변": ("Byun", "Byeon"),
    "염": ("Yeom", "Yum"),
    "여": ("Yeo", "Yuh"),
    "추": ("Choo", "Chu"),
    "도": ("Do", "Doh"),
    "소": ("So", "Soh"),
    "석": ("Seok", "Suk"),
    "선": ("Sun", "Seon"),
    "설": ("Seol", "Sul"),
    "마": ("Ma",),
    "길": ("Gil", "Kil"),
    "연": ("Yeon", "Youn"),
    "위": ("Wee", "Wi"),
    "표": ("Pyo",),
    "명": ("Myung", "Myeong"),
    "기": ("Ki", "Gi"),
    "반": ("Ban", "Bahn"),
    "왕": ("Wang",),
    "금": ("Keum", "Geum"),
    "옥": ("Ok",),
    "육": ("Yook", "Yuk"),
    "인": ("In",),
    "맹": ("Maeng",),
    "제": ("Je",),
    "모": ("Mo",),
    "탁": ("Tak",),
    "국": ("Kook", "Guk"),
    "어": ("Eo", "Uh"),
    "은": ("Eun",),
    "편": ("Pyun", "Pyeon"),
    "용": ("Yong",),
    "예": ("Ye",),
    "봉": ("Bong",),
    "사": ("Sa",),
    "부": ("Boo", "Bu"),
    "감": ("Kam", "Gam"),
    "복": ("Bok",),
    "빙": ("Bing",),
    "태": ("Tae",),
    "피": ("Pi",),
}
# Names of one organisation each that are known from the start.
ALIAS_GROUPS = (
    ("KAIST", "카이스트", "한국과학기술원", "Korea Advanced Institute of Science and Technology", "KOREA ADVANCED INST SCI & TECH"),
    ("KIST", "한국과학기술연구원", "Korea Institute of Science and Technology", "KOREA INST SCI & TECH"),
    ("ETRI", "한국전자통신연구원", "Electronics and Telecommunications Research Institute", "ELECTRONICS & TELECOMMUNICATIONS RES INST"),
    ("KERI", "한국전기연구원", "Korea Electrotechnology Research Institute"),
    ("KITECH", "한국생산기술연구원", "Korea Institute of Industrial Technology"),
    ("KRICT", "한국화학연구원", "Korea Research Institute of Chemical Technology"),
    ("KIER", "한국에너지기술연구원", "Korea Institute of Energy Research"),
    ("KIMS", "한국재료연구원", "Korea Institute of Materials Science"),
    ("KETI", "한국전자기술연구원", "Korea Electronics Technology Institute"),
    ("KIMM", "한국기계연구원", "Korea Institute of Machinery and Materials"),
    ("KAERI", "한국원자력연구원", "Korea Atomic Energy Research Institute"),
    ("POSTECH", "포스텍", "포항공과대학교", "포항공대", "Pohang University of Science and Technology", "POSTECH ACAD IND FOUND"),
    ("UNIST", "울산과학기술원", "Ulsan National Institute of Science and Technology"),
    ("GIST", "광주과학기술원", "Gwangju Institute of Science and Technology"),
    ("DGIST", "대구경북과학기술원", "Daegu Gyeongbuk Institute of Science and Technology"),
    ("SNU", "서울대학교", "서울대", "Seoul National University", "SEOUL NAT UNIV R&DB FOUNDATION"),
    ("고려대학교", "고려대", "Korea University"),
    ("연세대학교", "연세대", "Yonsei University"),
    ("SKKU", "성균관대학교", "성균관대", "Sungkyunkwan University"),
    ("한양대학교", "한양대", "Hanyang University"),
    ("영남대학교", "영남대", "Yeungnam University"),
    ("삼성전자", "Samsung Electronics", "SAMSUNG ELECTRONICS CO LTD"),
    ("삼성에스디아이", "삼성SDI", "Samsung SDI", "SAMSUNG SDI CO LTD"),
    ("LG에너지솔루션", "LG Energy Solution", "LG ENERGY SOLUTION LTD"),
    ("현대자동차", "현대차", "Hyundai Motor Company", "Hyundai Motor", "HYUNDAI MOTOR CO LTD"),
    ("SK하이닉스", "SK hynix", "SK HYNIX INC"),
)
