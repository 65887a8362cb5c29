"""Settings shared by the flows. Every function takes them as parameters too."""

# Column names of the forum dump -> names used here.
COLUMN_NAMES = {
    "ForumMessageID": "message_id",
    "ForumTopicID": "topic_id",
    "ForumGroupID": "group_id",
    "AccountID": "account_id",
    "PosterID": "poster_id",
    "PostDate": "post_date",
    "StartDate": "start_date",
    "MessageText": "message_text",
    "Name": "name",
}

# Account types. 1 = test, 2 and 3 = communities, 4 = demo.
SUPERUSER_ACCOUNTS = (1, 4)
COMMUNITY_ACCOUNTS = (2, 3)

# Group-name substrings of introduction, admin and off-topic channels.
INTRO_GROUP_KEYWORDS = (
    "welkom",
    "teamberichten",
    "stel je jezelf",
    "voorstellen",
    "gedichten",
    "ontspanning",
    "ontspanningsruimte",
    "gedichten en schrijfsels",
    "overig",
    "off-topic",
    "off topic",
    "wordgame",
    "woordspel",
    "woordspelletjes",
)

# Words by which moderators are searched.
MODERATOR_TERMS = ("moderator", "moderatoren", "beheerder")

# Text and sampling limits.
MIN_WORDS = 1
MIN_WORDS_INITIAL = 5
SHORT_MESSAGE_WORDS = 3
SAMPLE_SIZE = 500
USER_CAP = 4
SEED = 42
CAPS = (1, 2, 3, 5, 10)
SELECTED_FEATURES = 25
MIN_LABELLED_THREADS = 50
TARGET_LANGUAGE = "nl"

# Top-level lexicon categories kept as features.
TOP_LEVEL_CATEGORIES = (
    "WC", "function", "verb", "adj", "adverb", "negate", "affect", "social",
    "cogproc", "percept", "bio", "drives", "focuspast", "focuspresent",
    "focusfuture", "relativ", "work", "leisure", "home", "money", "relig",
    "death", "informal",
)

# Categories whose means the lexicon job reports.
KEY_CATEGORIES = (
    "posemo", "negemo", "anx", "anger", "sad", "affect", "social", "cogproc", "WC",
)

# Rows of one key above which a thread, user or label is numbered by range
# partitions instead of inside one window task.
HOT_ROWS = 2_000_000
