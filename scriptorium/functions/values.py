"""Word lists and tables.

Fixed values: results depend on these being as they are, so they stand here as text, in their natural order. Larger
authority tables (subject headings, regional lists, name lists) are parameters and are read from files.
"""

from __future__ import annotations

#: Titles with which a surname alone is a person.
PROFESSIONAL_TITLES = [
    "dr", "doctor", "prof", "professor", "dean", "president", "vice-president", "provost", "chancellor", "rector",
    "principal", "director", "chairman", "chairwoman", "chair", "superintendent", "commissioner", "secretary",
    "treasurer", "editor", "coach", "rev", "reverend", "father", "bishop", "cardinal", "archbishop", "rabbi",
    "minister", "pastor", "chaplain", "gen", "general", "col", "colonel", "major", "capt", "captain", "lt",
    "lieutenant", "sgt", "sergeant", "cpl", "corporal", "pvt", "private", "adm", "admiral", "cmdr", "commander",
    "gov", "governor", "sen", "senator", "rep", "representative", "amb", "ambassador", "judge", "justice", "mayor",
    "alderman", "alderperson", "constable",
]

#: Titles that count only beside a full name.
COURTESY_TITLES = ["mr", "mrs", "miss", "ms", "mme", "mdme"]

#: Words in lower or upper case inside a name.
NAME_CONNECTORS = [
    "de", "di", "du", "van", "von", "der", "den", "la", "le", "el", "al", "del", "della", "da", "do", "das", "dos",
    "mac",
]

#: Phrases that look like names of people.
NOT_PEOPLE = [
    "alma mater", "sub freshman", "sub-freshman", "old middle", "young republican", "young democrats", "big red",
]

#: Parts of names that make a person a place.
PLACE_KEYWORDS = [
    "dormitory", "dorm", "gallery", "auditorium", "gymnasium", "coliseum", "stadium", "arena", "amphitheatre",
    "amphitheater",
]

#: Occupations before a name, left out in comparisons.
CONTEXT_WORDS = [
    "headwaiter", "waiter", "waitress", "busboy", "hostess", "bartender", "cook", "chef", "steward", "stewardess",
    "photographer", "cameraman", "photog", "reporter", "journalist", "correspondent", "columnist", "writer",
    "author", "poet", "novelist", "playwright", "illustrator", "cartoonist", "designer", "student", "freshman",
    "sophomore", "junior", "senior", "alumnus", "alumna", "alum", "graduate", "grad", "scholar", "researcher",
    "fellow", "intern", "instructor", "teacher", "lecturer", "trustee", "regent", "member", "delegate", "envoy",
    "spokesman", "spokeswoman", "spokesperson", "volunteer", "worker", "employee", "aide", "assistant", "clerk",
    "owner", "proprietor", "founder", "operator", "librarian", "archivist", "curator", "coach", "trainer",
    "director", "administrator", "visiting", "adjunct", "acting", "associate", "former", "emeritus", "conductor",
    "musician", "singer", "performer", "artist", "painter", "sculptor", "actor", "actress", "architect", "engineer",
    "scientist", "lawyer", "attorney", "solicitor", "accountant", "consultant", "custodian", "janitor", "doorman",
    "guard", "officer", "athlete", "player", "golfer", "swimmer", "runner", "pitcher", "catcher", "quarterback",
    "halfback",
]

#: Those of the full profile alone; the basic profile has the others.
FULL_CONTEXT_WORDS = [
    "librarian", "archivist", "curator", "coach", "trainer", "director", "administrator", "visiting", "adjunct",
    "acting", "associate", "former", "emeritus",
]
BASIC_CONTEXT_WORDS = [w for w in CONTEXT_WORDS if w not in FULL_CONTEXT_WORDS]

#: Short first names and the full forms that stand for them in comparisons.
NICKNAMES = {
    "al": "alfred",
    "alex": "alexander",
    "abe": "abraham",
    "andy": "andrew",
    "art": "arthur",
    "bart": "bartholomew",
    "ben": "benjamin",
    "benny": "benjamin",
    "bill": "william",
    "billy": "william",
    "bob": "robert",
    "bobby": "robert",
    "brad": "bradley",
    "charlie": "charles",
    "chuck": "charles",
    "chris": "christopher",
    "dan": "daniel",
    "danny": "daniel",
    "dave": "david",
    "davy": "david",
    "dick": "richard",
    "don": "donald",
    "donny": "donald",
    "ed": "edward",
    "eddie": "edward",
    "ned": "edward",
    "ted": "edward",
    "fred": "frederick",
    "freddy": "frederick",
    "gene": "eugene",
    "geoff": "geoffrey",
    "gus": "augustus",
    "hal": "harold",
    "hank": "henry",
    "jack": "john",
    "jake": "jacob",
    "jeff": "jeffrey",
    "jim": "james",
    "jimmy": "james",
    "joe": "joseph",
    "joey": "joseph",
    "johnny": "john",
    "jon": "jonathan",
    "ken": "kenneth",
    "kenny": "kenneth",
    "larry": "lawrence",
    "len": "leonard",
    "lenny": "leonard",
    "lew": "lewis",
    "louie": "louis",
    "lou": "louis",
    "matt": "matthew",
    "mike": "michael",
    "mickey": "michael",
    "mitch": "mitchell",
    "nat": "nathaniel",
    "nate": "nathaniel",
    "nick": "nicholas",
    "pat": "patrick",
    "pete": "peter",
    "phil": "philip",
    "ray": "raymond",
    "rich": "richard",
    "rick": "richard",
    "ricky": "richard",
    "rob": "robert",
    "ron": "ronald",
    "ronny": "ronald",
    "sam": "samuel",
    "sammy": "samuel",
    "sandy": "alexander",
    "stan": "stanley",
    "steve": "stephen",
    "stevie": "stephen",
    "tim": "timothy",
    "timmy": "timothy",
    "tom": "thomas",
    "tommy": "thomas",
    "tony": "anthony",
    "vin": "vincent",
    "vince": "vincent",
    "wally": "walter",
    "walt": "walter",
    "will": "william",
    "willie": "william",
}

#: Words in lists of given names that are none.
NOT_GIVEN_NAMES = [
    "american", "building", "central", "eastern", "general", "great", "international", "lower", "national", "new",
    "northern", "old", "royal", "southern", "upper", "western",
]

#: Terms that taggers take for places.
NOT_PLACES = [
    "absentia", "alma", "mater", "alma mater", "cum laude", "magna cum laude", "summa cum laude", "in absentia",
    "abroad", "abroad.", "home", "here", "there", "elsewhere", "local", "national", "regional", "international",
    "absurd", "abstract", "abilities", "ability", "absence", "absent", "abode", "abash", "abyss", "campus",
    "library", "chapel", "commons", "dormitory", "dorm", "classroom", "lecture hall", "auditorium", "arts", "news",
    "sports", "features", "editorial", "opinion", "section", "page", "column", "issue", "street", "avenue", "road",
    "lane", "drive", "building", "hall", "county", "state", "city", "town", "village", "nation", "world", "globe",
    "universe", "a", "an", "the", "in", "at", "of", "on", "to", "by",
]

#: Headings that a bare place name has before any list is asked.
OVERRIDES = {
    "clinton": "Clinton (N.Y.)",
    "utica": "Utica (N.Y.)",
    "rome": "Rome (N.Y.)",
    "hamilton": "Hamilton (N.Y.)",
    "oneida": "Oneida (N.Y.)",
    "albany": "Albany (N.Y.)",
    "rochester": "Rochester (N.Y.)",
    "buffalo": "Buffalo (N.Y.)",
    "ithaca": "Ithaca (N.Y.)",
    "syracuse": "Syracuse (N.Y.)",
    "binghamton": "Binghamton (N.Y.)",
    "schenectady": "Schenectady (N.Y.)",
    "troy": "Troy (N.Y.)",
    "amherst": "Amherst (Mass.)",
    "middlebury": "Middlebury (Vt.)",
    "princeton": "Princeton (N.J.)",
    "cambridge": "Cambridge (Mass.)",
    "hanover": "Hanover (N.H.)",
    "boston": "Boston (Mass.)",
    "philadelphia": "Philadelphia (Pa.)",
    "chicago": "Chicago (Ill.)",
    "washington": "Washington (D.C.)",
    "paris": "Paris (France)",
    "london": "London (England)",
    "berlin": "Berlin (Germany)",
    "moscow": "Moscow (Russia)",
    "tokyo": "Tokyo (Japan)",
    "geneva": "Geneva (Switzerland)",
    "new york": "New York (N.Y.)",
    "new york state": "New York (State)",
    "new jersey": "New Jersey",
    "pennsylvania": "Pennsylvania",
    "massachusetts": "Massachusetts",
    "connecticut": "Connecticut",
    "vermont": "Vermont",
    "new hampshire": "New Hampshire",
    "maine": "Maine",
    "rhode island": "Rhode Island",
    "maryland": "Maryland",
    "virginia": "Virginia",
    "north carolina": "North Carolina",
    "south carolina": "South Carolina",
    "georgia": "Georgia",
    "florida": "Florida",
    "ohio": "Ohio",
    "michigan": "Michigan",
    "indiana": "Indiana",
    "illinois": "Illinois",
    "wisconsin": "Wisconsin",
    "minnesota": "Minnesota",
    "iowa": "Iowa",
    "missouri": "Missouri",
    "california": "California",
    "texas": "Texas",
    "england": "England",
    "france": "France",
    "germany": "Germany",
    "united states": "United States",
    "canada": "Canada",
    "russia": "Russia",
    "china": "China",
    "japan": "Japan",
    "italy": "Italy",
    "spain": "Spain",
    "ireland": "Ireland",
    "scotland": "Scotland",
    "wales": "Wales",
    "australia": "Australia",
    "india": "India",
    "mexico": "Mexico",
    "brazil": "Brazil",
    "argentina": "Argentina",
    "south africa": "South Africa",
}

#: Parts of names that are no name by themselves.
PARTICLES = [
    "van", "von", "vom", "ver", "den", "der", "ten", "ter", "zu", "zur", "zum", "im", "am", "auf", "de", "del",
    "della", "delle", "degli", "dei", "di", "du", "des", "da", "das", "do", "dos", "la", "le", "les", "las", "lo",
    "los", "al", "el", "bin", "bint", "ibn", "abu", "abd", "ul", "ur", "af", "av", "og", "of", "the", "and", "a",
    "e", "i", "o", "y",
]

#: Words before the comma that make a heading a corporate body.
CORPORATE_WORDS = [
    "workshop", "conference", "symposium", "seminar", "colloquium", "congress", "meeting", "forum", "summit",
    "convention", "institute", "association", "society", "university", "college", "school", "academy", "federation",
    "commission", "committee", "council", "board", "bureau", "office", "department", "division", "agency",
    "authority", "ministry", "service", "company", "corporation", "inc", "ltd", "llc", "foundation", "trust",
    "group", "organization", "organisation", "international", "national", "federal", "royal", "imperial",
    "expedition", "survey", "project", "program", "programme", "working", "study", "studies", "research", "center",
    "centre", "network", "alliance", "coalition", "consortium",
]

#: First words behind the comma that make a heading no person.
NOT_FORENAMES = [
    "and", "or", "the", "inc", "corp", "ltd", "llc", "co", "plc", "company", "companies", "associates", "brothers",
    "sons", "daughters", "publications", "publishing", "press", "bureau", "books", "films", "university", "college",
    "institute", "school", "academy", "seminary", "department", "committee", "office", "division", "board",
    "agency", "authority", "commission", "council", "ministry", "society", "association", "federation",
    "organization", "organisation", "foundation", "trust", "fund", "group", "international", "national", "federal",
    "state", "regional", "local", "united", "royal", "imperial", "active", "approximately", "ca", "fl",
    "flourished", "b", "d", "family", "families", "complete", "selected", "collected", "works", "selections", "von",
    "van", "de", "del", "di", "du", "der", "das", "die", "les",
]

#: First words behind the comma that are titles.
RANKS = [
    "sir", "dame", "lord", "lady", "baron", "baroness", "earl", "count", "countess", "duke", "duchess", "marquess",
    "viscount", "prince", "princess", "king", "queen", "emperor", "empress", "tsar", "tsarina", "mr", "mrs", "ms",
    "miss", "dr", "prof", "rev", "hon", "capt", "maj", "col", "gen", "adm", "lt", "sgt", "pope", "bishop",
    "archbishop", "cardinal", "abbot", "abbess", "father", "brother", "sister", "saint",
]

#: Gazetteer classes that count as places.
FEATURE_CLASSES = [
    "Populated Place", "Stream", "Lake", "Summit", "Valley", "Spring", "Island", "Cape", "Ridge", "Bay", "Flat",
    "Gap", "Swamp", "Bar", "Cliff", "Basin", "Channel", "Bend", "Falls", "Range", "Beach", "Area", "Pillar",
    "Rapids", "Glacier", "Bench", "Arch", "Woods", "Slope", "Plain", "Crater", "Arroyo", "Lava", "Isthmus", "Sea",
]

#: Postal codes of states.
STATE_CODES = {
    "Alabama": "AL",
    "Alaska": "AK",
    "Arizona": "AZ",
    "Arkansas": "AR",
    "California": "CA",
    "Colorado": "CO",
    "Connecticut": "CT",
    "Delaware": "DE",
    "Florida": "FL",
    "Georgia": "GA",
    "Hawaii": "HI",
    "Idaho": "ID",
    "Illinois": "IL",
    "Indiana": "IN",
    "Iowa": "IA",
    "Kansas": "KS",
    "Kentucky": "KY",
    "Louisiana": "LA",
    "Maine": "ME",
    "Maryland": "MD",
    "Massachusetts": "MA",
    "Michigan": "MI",
    "Minnesota": "MN",
    "Mississippi": "MS",
    "Missouri": "MO",
    "Montana": "MT",
    "Nebraska": "NE",
    "Nevada": "NV",
    "New Hampshire": "NH",
    "New Jersey": "NJ",
    "New Mexico": "NM",
    "New York": "NY",
    "North Carolina": "NC",
    "North Dakota": "ND",
    "Ohio": "OH",
    "Oklahoma": "OK",
    "Oregon": "OR",
    "Pennsylvania": "PA",
    "Rhode Island": "RI",
    "South Carolina": "SC",
    "South Dakota": "SD",
    "Tennessee": "TN",
    "Texas": "TX",
    "Utah": "UT",
    "Vermont": "VT",
    "Virginia": "VA",
    "Washington": "WA",
    "West Virginia": "WV",
    "Wisconsin": "WI",
    "Wyoming": "WY",
    "District of Columbia": "DC",
    "Puerto Rico": "PR",
    "Guam": "GU",
    "American Samoa": "AS",
    "Northern Mariana Islands": "MP",
    "Virgin Islands": "VI",
}

#: Fields of a catalogue record, in order.
FIELDS = [
    "local_identifier", "title", "subtitle", "title_alternative", "sort_order", "series_title", "description",
    "provenance", "note", "abstract", "date_full", "date_note", "personal_name", "personal_name_addressee",
    "personal_name_artist", "personal_name_author", "personal_name_cartographer", "personal_name_compiler",
    "personal_name_composer", "personal_name_contributor", "personal_name_dedicatee", "personal_name_editor",
    "personal_name_illustrator", "personal_name_interviewee", "personal_name_interviewer", "personal_name_owner",
    "personal_name_photographer", "personal_name_publisher", "personal_name_publishingdirector",
    "personal_name_speaker", "personal_name_translator", "corporate_name", "corporate_name_addressee",
    "corporate_name_author", "corporate_name_owner", "corporate_name_photographer", "family_name", "type", "genre",
    "subgenre_audiovisual_materials", "subgenre_ephemera", "subgenre_manuscripts", "subgenre_publications",
    "subgenre_visual_materials", "publisher_name", "place_of_publication", "language", "extent",
    "table_of_contents", "building_name", "subject_personal_name", "subject_corporate_name", "subject_family_name",
    "subject_geographic", "subject_cartographic_coordinates", "geographic_location", "subject_topical",
    "ismemberof", "ispartof", "sequence_id", "shelf_location", "physical_location", "restrictions_on_access",
    "rights_statements", "audios", "images", "models", "videos", "documents",
]

#: Those that must not be empty.
REQUIRED_FIELDS = [
    "local_identifier", "title", "type", "genre", "subgenre_audiovisual_materials", "subgenre_ephemera",
    "subgenre_manuscripts", "subgenre_publications", "subgenre_visual_materials", "ismemberof", "description",
    "rights_statements",
]

#: Known values of type.
VALID_TYPES = ["object", "collection", "image", "sound", "text", "video", "map", "thesis", "publication"]

#: Known language codes.
VALID_LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "zh", "ja", "ko", "ru", "ar", "hi"]

PERSONAL_NAME_FIELDS = [f for f in FIELDS if f.startswith("personal_name")]
CORPORATE_NAME_FIELDS = [f for f in FIELDS if f.startswith("corporate_name")]
FILE_FIELDS = ["audios", "images", "models", "videos", "documents"]

#: Values of fields that are present and empty.
DEFAULTS = {
    "restrictions_on_access": "There are no restrictions on access to this resource.",
    "language": "en",
    "type": "object",
}

#: Words that stay in lower case inside a name.
SMALL_WORDS = ["of", "and", "the", "van", "von", "de", "la", "le"]
