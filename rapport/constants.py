"""Word lists, lookup tables, patterns and formats.

Everything in this module is data that must keep its exact value for results
to come out right; no logic lives here.
"""

# -- separators and whitespace ------------------------------------------------
ID_SEPARATOR = "\u001f"

# Characters counted as whitespace by Unicode-aware text tools (Java's ``\s``
# is ASCII only).
WS_CLASS = "[\\s\\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\u0085\u2028\u2029]"
WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
INVISIBLE_MARKS = "[\u200e\u200f\u202a-\u202e\ufeff]"

# -- people -------------------------------------------------------------------
USER_LABELS = ["me", "you", "myself", "self"]

PLACEHOLDER_LABELS = [
    "instagram user", "instagram", "messenger", "unknown", "unknown user",
    "deleted user", "deleted account", "deactivated", "former user",
]

USERNAME_PREFIXES = [
    "@", "https://instagram.com/", "https://x.com/", "https://twitter.com/",
    "instagram.com/", "x.com/", "twitter.com/", "t.me/", "https://t.me/",
]

# -- chat export grammar --------------------------------------------------------
CHAT_DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
CHAT_TIME = r"\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?"

CHAT_NOISE_PREFIXES = [
    "messages and calls are end-to-end encrypted",
    "end-to-end encrypted",
    "this message was deleted",
    "you deleted this message",
    "waiting for this message",
    "tap and hold to unpin",
    "missed voice call",
    "missed video call",
    "changed the group description",
    "changed this group's subject",
    "created group",
    "added you",
    "left",
    "changed the group icon",
    "security code",
    "turned on disappearing messages",
    "turned off disappearing messages",
]

CHAT_SYSTEM_VERBS = (
    r"(?i)\b(added|removed|left|created|changed|turned on|turned off|deleted|"
    r"joined|pinned|cleared|is a participant|made)\b"
)

MEDIA_EXTENSION_ALTERNATIVES = (
    "jpg|jpeg|png|webp|heic|gif|bmp|tif|tiff|mp4|3gp|mov|mkv|"
    "opus|ogg|oga|amr|m4a|mp3|wav|aac|wma|webm|pdf|doc|docx|"
    "xls|xlsx|ppt|pptx|vcf|epub|zip"
)
ATTACHED_IN_ANGLES = r"(?i)<?attached:\s*([^>\n]+?)\s*>"
FILE_ATTACHED = (
    r'(?i)([^\s<>"|*?]+?\.(?:' + MEDIA_EXTENSION_ALTERNATIVES + r"))"
    r"\s*\(\s*file attached\s*\)"
)
MEDIA_FILENAME = (
    r'(?i)((?:IMG|PHOTO|PTT|AUD|VID|GIF|STK|DOC)[-_][^\s<>"|*?]+?'
    r"\.(?:" + MEDIA_EXTENSION_ALTERNATIVES + r"))"
)
MEDIA_OMITTED = (
    r"(?i)media omitted|image omitted|video omitted|audio omitted|"
    r"document omitted|gif omitted|sticker omitted"
)
MEDIA_WORD_ONLY = (
    r"(?i)^(?:<)?(?:image|video|audio|voice|sticker|gif|document|contact card)"
    r"(?:\s+omitted|\s+attached|\s+\.?\w+)?(?:>)?$"
)

# -- media ----------------------------------------------------------------------
MEDIA_TYPES = {
    ".jpg": ("image", "image/jpeg"),
    ".jpeg": ("image", "image/jpeg"),
    ".png": ("image", "image/png"),
    ".gif": ("image", "image/gif"),
    ".webp": ("image", "image/webp"),
    ".heic": ("image", "image/heic"),
    ".bmp": ("image", "image/bmp"),
    ".tif": ("image", "image/tiff"),
    ".tiff": ("image", "image/tiff"),
    ".mp4": ("video", "video/mp4"),
    ".3gp": ("video", "video/3gpp"),
    ".mov": ("video", "video/quicktime"),
    ".mkv": ("video", "video/x-matroska"),
    ".opus": ("voice", "audio/ogg"),
    ".ogg": ("voice", "audio/ogg"),
    ".oga": ("voice", "audio/ogg"),
    ".amr": ("voice", "audio/amr"),
    ".m4a": ("audio", "audio/mp4"),
    ".mp3": ("audio", "audio/mpeg"),
    ".wav": ("audio", "audio/wav"),
    ".aac": ("audio", "audio/aac"),
    ".wma": ("audio", "audio/x-ms-wma"),
    ".webm": ("audio", "audio/webm"),
    ".pdf": ("document", "application/pdf"),
    ".doc": ("document", "application/msword"),
    ".docx": ("document", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".xls": ("document", "application/vnd.ms-excel"),
    ".xlsx": ("document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ".ppt": ("document", "application/vnd.ms-powerpoint"),
    ".pptx": ("document", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ".vcf": ("document", "text/vcard"),
    ".epub": ("document", "application/epub+zip"),
    ".zip": ("document", "application/zip"),
}
MEDIA_DEFAULT = ("other", "application/octet-stream")
MEDIA_PREFIX_KINDS = {
    "IMG": "image", "PHOTO": "image", "PTT": "voice", "AUD": "audio",
    "VID": "video", "GIF": "video", "STK": "sticker", "DOC": "document",
}
RECORDING_KINDS = ("voice", "audio")
MEDIA_MAX_BYTES = 200 * 1024 * 1024

RESERVED_FILE_STEMS = (
    ["CON", "PRN", "AUX", "NUL"]
    + [f"COM{i}" for i in range(1, 10)]
    + [f"LPT{i}" for i in range(1, 10)]
)
FILENAME_MAX = 180

# -- import limits and routing ----------------------------------------------------
ALLOWED_EXTENSIONS = [
    ".txt", ".md", ".json", ".js", ".csv", ".html", ".htm", ".eml", ".mbox",
    ".ics", ".vcf", ".zip", ".pdf", ".docx",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".heic",
    ".mp4", ".mov", ".webm", ".3gp", ".mkv",
    ".opus", ".m4a", ".mp3", ".ogg", ".wav", ".aac", ".flac",
]
RECORDED_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".heic",
    ".mp4", ".mov", ".webm", ".3gp", ".mkv",
    ".opus", ".m4a", ".mp3", ".ogg", ".wav", ".aac", ".flac",
]
AUDIO_EXTENSIONS = [".wav", ".mp3", ".m4a", ".ogg", ".webm"]
ARCHIVE_MAX_BYTES = 500 * 1024 * 1024
ARCHIVE_MAX_ENTRIES = 5000
ARCHIVE_MAX_DEPTH = 3
SNIFF_BYTES = 4000

SOURCE_BY_FOLDER = {
    "whatsapp": "whatsapp", "telegram": "telegram", "instagram": "instagram",
    "x": "x", "twitter": "x", "email": "email", "calendar": "calendar",
    "contacts": "contacts", "voice": "voice", "chats": "chat", "chat": "chat",
    "notes": "notes", "documents": "document",
}
SOURCES = [
    "whatsapp", "telegram", "instagram", "x", "email", "calendar",
    "contacts", "notes", "voice", "chat", "document",
]

IN_PROGRESS_SUFFIXES = [
    ".crdownload", ".part", ".partial", ".download",
    ".tmp", ".temp", ".filepart", ".swp", ".swx",
]
IN_PROGRESS_NAMES = [".ds_store", "thumbs.db", "desktop.ini", "icon\r"]
IN_PROGRESS_PREFIXES = ["~$", ".~", ".#"]

EXPORT_MARKER_DIRS = [
    "personal_information", "your_instagram_activity", "connections",
    "ads_information", "security_and_login_information",
    "apps_and_websites_off_of_instagram", "logged_information",
    "preferences", "monetization",
]
EXPORT_MARKER_PREFIXES = ["instagram-", "meta-"]
EXPORT_INBOX_DIRS = ["messages", "inbox"]
EXPORT_ATTACHMENT_DIRS = ["photos", "videos", "audio", "gifs", "files"]
EXPORT_MESSAGE_SUFFIXES = [".json", ".ndjson", ".html", ".htm"]

# -- column aliases of tabular imports ---------------------------------------------
GENERIC_ALIASES = {
    "timestamp": ["timestamp", "time", "date", "datetime", "created_at",
                  "createdat", "sent_at", "sentat", "ts", "when"],
    "sender": ["sender", "from", "author", "user", "username", "name",
               "sender_name", "sendername", "contact", "phone_number"],
    "content": ["content", "message", "text", "body", "msg", "value",
                "message_text", "comment"],
    "conversation": ["conversation", "chat", "chat_id", "thread", "room",
                     "dialog", "channel", "title"],
}
EMAIL_ALIASES = {
    "from": ["from", "sender", "from_address", "sender_email"],
    "to": ["to", "recipients", "recipient", "cc"],
    "body": ["body", "text", "content", "message", "snippet", "html"],
    "subject": ["subject", "title"],
    "date": ["date", "timestamp", "sent_at", "time"],
}
CALENDAR_ALIASES = {
    "title": ["title", "subject", "summary", "event", "name"],
    "start": ["start", "starts_at", "dtstart", "begin", "date", "when"],
    "end": ["end", "ends_at", "dtend", "finish"],
    "participants": ["participants", "attendees", "guests", "people", "invitees"],
    "location": ["location", "place", "room"],
    "description": ["description", "details", "notes"],
}
CONTACT_ALIASES = {
    "name": ["name", "full name", "fullname", "display name", "contact name", "first name"],
    "first": ["first name", "firstname", "given name"],
    "last": ["last name", "lastname", "family name", "surname"],
    "phone": ["phone", "phone number", "mobile", "tel", "telephone", "whatsapp", "cell"],
    "email": ["email", "e-mail", "email address", "mail"],
    "organization": ["organization", "organisation", "company", "org", "work"],
    "nickname": ["nickname", "nick", "alias"],
}
CONTACT_HANDLES = ["instagram", "twitter", "x", "telegram", "username", "handle"]

# "31/12/23 23:59 <Ann> hi", "... [Ann] hi", "... - Ann: hi", "Ann: hi"
GENERIC_DATETIME = (
    r"\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}[, T]\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?"
)
GENERIC_LINE_PATTERNS = [
    r"^(" + GENERIC_DATETIME + r")\s*(?:[-–>]\s*)?<([^>]+)>\s*(.*)$",
    r"^(" + GENERIC_DATETIME + r")\s*(?:[-–>]\s*)?\[([^\]]+)\]\s*(.*)$",
    r"^(" + GENERIC_DATETIME + r")\s*[-–]\s*([^<>\[\]]{1,60}?):\s*(.*)$",
    r"^()([A-Za-z][A-Za-z .'\-]{0,40}):\s+(\S.*)$",
]

TELEGRAM_MEDIA_KEYS = ["photo", "file", "thumbnail", "sticker_emoji", "path",
                       "media_type", "voice", "video_file"]
META_ATTACHMENT_FIELDS = [("photos", "image"), ("videos", "video"), ("audio", "audio"),
                          ("gifs", "image"), ("audio_files", "audio"), ("files", "file")]

# -- search terms -----------------------------------------------------------------
SEARCH_STOPWORDS = """
a about after all also an and any are as at be been but by can did do does for
from had has have he her him his how i if in into is it its me my no not of on
or our out she should so some such than that the their them then there these
they this to too up us was we were what when where which who whom why will with
would you your
""".split()

STEM_SUFFIXES = ("ing", "ed", "es", "s")

DESKTOP_STOPWORDS = """
a an the and or but if then else for of to in on at by with from as is are was were be been being
it its this that these those i you he she we they me him her us them my your his our their
do does did done have has had will would can could should may might must not no yes ok okay
just so very really about into over under again more most some any all what when where who how why
im ive dont doesnt didnt cant wont thats theres youre theyre whats hi hey hello yeah yep nope
pls plz please thanks thank you
""".split()

# -- topic noise ---------------------------------------------------------------------
TOPIC_STOPWORDS = [
    "the", "and", "for", "you", "your", "that", "with", "this", "have", "was",
    "are", "but", "not", "can", "will", "just", "they", "them", "then", "than",
    "what", "when", "where", "who", "how", "why", "all", "any", "our", "out",
    "get", "got", "had", "has", "him", "his", "her", "she", "been", "from",
    "were", "there", "their", "would", "could", "should", "about", "into",
    "over", "under", "again", "still", "very", "much", "some", "like", "want",
    "don't", "didn't", "can't", "i'm", "it's", "that's", "im", "ive", "ok",
    "okay", "yes", "no", "lol", "haha", "thanks", "thank", "please", "hello",
    "hi", "hey", "good", "morning", "night", "today", "tomorrow", "yesterday",
    "http", "https", "www", "com", "image", "omitted", "media", "sticker",
    "voice", "message", "video", "audio", "attachment", "file",
]
TOPIC_SYSTEM_EVENTS = [
    "reacted", "liked", "shared", "forwarded", "removed", "unsupported",
    "attachment", "attachments", "image", "omitted", "sticker", "video",
    "audio", "voice message", "sent an attachment", "media omitted",
    "this message was deleted", "message deleted", "edited", "pinned",
    "replied", "seen", "delivered", "read", "typing", "joined", "left",
    "jpg", "png", "pdf", "mp4", "img", "photo", "link", "document",
]
TOPIC_CHAT_FILLER = [
    "everyone", "anyone", "someone", "somebody", "nobody", "nothing",
    "guys", "folks", "bros", "bro", "dude", "yaar", "team",
    "those", "these", "this", "that", "it", "there", "here",
    "happy", "birthday", "good", "morning", "night", "evening", "today",
    "tomorrow", "yesterday", "week", "month", "day", "days", "time", "date",
    "everyone's", "any", "some", "all", "both", "each", "few", "many",
    "yeah", "yep", "yup", "nope", "nah", "okay", "ok", "fine", "cool",
    "nice", "great", "super", "thanks", "thank", "please", "sorry",
    "hmm", "hyy", "ohh", "oh", "ah", "ha", "haha", "hehe", "lol",
    "hlo", "hru", "byee", "yoo", "haa", "haan", "take", "stay", "tell",
    "append", "check", "sent", "send", "ping", "reply", "call", "later",
    "tmrw", "tommorow", "aprm", "mr", "mrs", "ms", "sir", "madam", "dear",
    "regards", "welcome", "excuse", "meet", "meeting",
    "note", "notes", "kindly", "forward", "fwd", "photo", "video",
]
TOPIC_FILLER_STEMS = [
    "naa", "naan", "naaa", "dei", "deii", "deiii", "dee", "nee", "nan",
    "nann", "enna", "eppo", "ithu", "ithula", "appa", "akka", "thambi",
    "poda", "seri", "ama", "han", "illa", "illai", "ena", "dm", "ok", "okk",
    "hmm", "hru", "hlo", "tmrw", "mk", "plz", "pls", "thala", "vaa",
    "dai", "day", "enaku", "aku", "lo", "la",
    "okayy", "okey", "asap", "grp", "machan", "bro", "sis", "k",
]
TOPIC_PHRASE = r"\b([A-Z][a-zA-Z0-9]+(?:[ \-]+[A-Z][a-zA-Z0-9]+){0,3})\b"
TOPIC_TOKEN = r"[a-zA-Z][a-zA-Z0-9#]{3,}"

# -- status ladder ---------------------------------------------------------------------
STATUS_VERY_ACTIVE = "Very Active"
STATUS_ACTIVE = "Active"
STATUS_OCCASIONAL = "Occasional"
STATUS_LOW = "Low Activity"
STATUS_NONE = "No Recent Activity"

# -- questions -------------------------------------------------------------------------
CUTOFF_PATTERNS = [
    (r"\blast (?:24 hours|day|24h)\b", 1),
    (r"\btoday\b", 1),
    (r"\byesterday\b", 2),
    (r"\blast (?:7 days|week)\b", 7),
    (r"\bthis week\b", 7),
    (r"\blast (?:14 days|two weeks)\b", 14),
    (r"\blast (?:30 days|month)\b", 30),
    (r"\blast (?:90 days|three months)\b", 90),
    (r"\bthis year\b", 365),
]
VOICE_HINTS = ["voice note", "voice memo", "recording"]

PREPARE_PHRASES = ["prepare me", "prepare for", "brief for", "get me ready", "meeting brief"]
SUMMARY_PHRASES = ["relationship"]

FREQUENCY_MARK = r"(?:the\s+most|most|frequently|often)"
TALK_VERB = r"(?:talk|speak|spoken|chat|text|message|interact)"
TOP_PEOPLE_PATTERNS = [
    r"\bwho (?:do|does|have|has) i " + TALK_VERB + r"(?:s|ed|ing)?\w*"
    r"\s+(?:to\s+|with\s+)?(?:people\s+|them\s+)?" + FREQUENCY_MARK,
    r"\bwho (?:is|are) (?:my|the|our)\s+"
    r"(?:top|closest|best|main|few|most active|frequent)\w*\s+"
    r"(?:contacts?|people|persons?|friends?)",
    r"\b(?:my|the|our)\s+(?:top|closest|best|main|few|most active)\w*\s+"
    r"(?:contacts?|people|persons?|friends?)",
    r"\b(?:most|top)\s+(?:talked|chatted|messaged|active|communicated)\w*"
    r"\s+(?:to\s+)?(?:people|contacts?|persons?|friends?)",
    r"\bwhich people\b.*\b" + FREQUENCY_MARK,
    r"\b(?:to|with)\s+whom\b[^.?!]{0,40}?\b" + FREQUENCY_MARK,
    r"\bwhom\s+(?:do|does|did|should|will)\s+i\b[^.?!]{0,40}?\b" + FREQUENCY_MARK,
    r"\bwho\b(?!\s+(?:is|are|was|were)\b)[^.?!]{0,30}?\b" + TALK_VERB
    + r"(?:s|ed|ing)?\w*[^.?!]{0,20}?\b" + FREQUENCY_MARK,
    r"\bhow (?:often|many times) (?:do|does) i talk\b",
    r"\bwho do i know (?:the )?(?:best|most)\b",
]
TOP_PEOPLE_EXCLUDE = r"\btalk(?:ed|ing|s)?\s+about\b|\bwhat\b.*\btopic"

ACTIVITY_UNITS = {
    "voice notes": "voice", "voice note": "voice", "voice messages": "voice",
    "messages": "message", "message": "message",
    "texts": "message", "text": "message",
    "chats": "message", "chat": "message",
    "emails": "email", "email": "email",
    "mails": "email", "mail": "email",
    "meetings": "meeting", "meeting": "meeting",
    "calls": "meeting", "call": "meeting",
    "interactions": None, "interaction": None,
}
ACTIVITY_SINGULAR = {"message": "message", "email": "email", "meeting": "meeting",
                     "voice": "voice note"}
ACTIVITY_ANY = "interaction"
ACTIVITY_COUNT_LEAD = r"\b(?:how many|how much)\s+(?:of\s+my\s+|my\s+)?"
ACTIVITY_TIMES = (
    r"\bhow many times\b[^.?!]{0,40}?\b"
    r"(?:talk|speak|spoke|chat|text|message|interact|call|meet)\w*"
)
ACTIVITY_EXCLUDE = r"\babout\b"
PEOPLE_COUNT = (
    r"\bhow (?:many|much)\s+(?:of\s+my\s+)?(?:people|persons?|contacts?|friends?)\b"
    r"[^.?!]{0,30}?\b(?:i|we|me|my|our)\b"
    r"|\bhow (?:many|much)\s+(?:people|persons?|contacts?|friends?)\s+(?:do|did|have|has)\s+(?:i|we)\b"
    r"|\b(?:number|count) of (?:people|persons?|contacts?|friends?)\b[^.?!]{0,20}?\b(?:i|we|my|our)\b"
)
LAST_INTERACTION = (
    r"\bwhen (?:did|do|was|were)\s+(?:i|we)\s+(?:last\s+)?"
    r"(?:talk|speak|chat|text|message|interact|call|meet|hear from)\w*"
    r"|\blast time\s+(?:i|we)\s+(?:talked|spoke|chatted|texted|messaged|met|called)\b"
    r"|\bwhen did i last hear from\b"
)
LAST_INTERACTION_EXCLUDE = r"\btalk(?:ed|ing)?\s+about\b|\bdiscuss(?:ed|ion)?\b|\bconcerning\b"
RECENT_PEOPLE = (
    r"\bwho\b[^.?!]{0,30}?\b(?:talk|speak|spoken|chat|text|message|interact|meet|call)\w*"
)
RECENT_PEOPLE_EXCLUDE = r"\btalk(?:ed|ing)?\s+about\b|\bdiscuss\b"
TOP_TOPICS = (
    r"\b(?:my|our|the)\s+(?:top|main|common|frequent|main)\w*\s+topics?\b"
    r"|\btopics?\b[^.?!]{0,30}?\b(?:most|frequently|often)\b"
    r"|\bwhat (?:do|does|did) (?:i|we)\s+(?:talk|chat|speak)\s+about\s+(?:the\s+)?most\b"
    r"|\bwhat are (?:my|our)\s+(?:main\s+)?topics\b"
)
TOP_TOPICS_EXCLUDE = r"\bwhen\b[^.?!]{0,20}?\b(?:discuss|talk)\b|\bwhy\b"
ARCHIVE_INTENTS = ["activity_count", "people_count", "last_interaction",
                   "recent_people", "top_topics"]

# -- evidence ---------------------------------------------------------------------------
VECTOR_WEIGHT = 1.0
KEYWORD_WEIGHT = 0.7
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75
# (records, snippet characters, total characters)
BUDGET_SEARCH = (10, 900, 0)
BUDGET_ANSWER = (4, 240, 1000)
BUDGET_BRIEF = (6, 280, 1700)
CITATION = r"\[(S\d+(?:\s*,\s*S\d+)*)\]"
INSUFFICIENT = "I couldn't find enough evidence in your imported data."
SOURCE_LABELS = {
    "whatsapp": "WhatsApp", "telegram": "Telegram", "instagram": "Instagram",
    "x": "X", "email": "Email", "calendar": "Calendar", "notes": "Note",
    "chat": "Chat", "voice": "🎙️", "document": "Document",
}
CHUNK_CHARS = 1200

# Suggestion confidences.
CONFIDENCE_NAME_MATCH = 0.55
CONFIDENCE_DUPLICATE = 0.6
CONFIDENCE_VOICE_MENTION = 0.5

# People listing.
PEOPLE_PAGE_MAX = 200
PEOPLE_SORTS = ["recent", "name", "interactions"]
