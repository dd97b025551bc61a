"""Fixed values.

Results depend on these being exactly as they are: words, patterns, limits and
prompt texts that other systems already produce or expect.
"""

# File naming of a run.
LISTING_PREFIX = "sorted_data"
LISTING_SUFFIX = ".json"
RUN_STAMP = "yyyy_MM_dd__HH_mm_ss"

# Page structure.
CHROME_TAGS = ("header", "footer")
PAGINATION_CLASS = "woocommerce-pagination"

# Text patterns.
# The alternatives of http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+ as one
# class: all but the last are single characters and "$-_" has the percent sign. A repeated choice would
# take one level of the stack for each character of a URL.
URL_PATTERN = r"http[s]?://[a-zA-Z0-9$-_@.&+!*\\(\\),]+"
FENCE_PATTERN = r"(?s)```json\n(.*?)\n```"
RETRY_PATTERN = r"Please try again in ([\d\.]+)s"
RATE_LIMIT_MARK = "rate_limit_exceeded"
UNAVAILABLE_MARK = "503"

# Limits and defaults.
REQUESTS_PER_MINUTE = 30
TOKENS_PER_MINUTE = 20000
TOKENS_PER_DAY = 500000
TOKEN_CUT = 120000
SIMILARITY_THRESHOLD = 0.8
MAPPING_SAMPLE = 3
PREVIEW_ROWS = 25

# Cleaned columns.
PRICE_COLUMN = "price"
URL_COLUMNS = ("image_url", "product_url")
CURRENCY_SIGNS = "$£€"
PRICE_SIGN = "€"

# Price per token by model name (input, output).
MODEL_PRICES = {"Groq Llama3.1 70b": (0.0, 0.0)}

# Prompt texts. FIELDS stands for the '"field": "type"' lines.
USER_PREFIX = "Extract the following information from the provided text:\nPage content:\n\n"
FIELD_SEPARATOR = ",\n"
SYSTEM_TEXT = """
    You are an intelligent text extraction and conversion assistant. Your task is to extract structured information 
                        from the given text and convert it into a pure JSON format. The JSON should contain only the structured data extracted from the text, 
                        with no additional commentary, explanations, or extraneous information. 
                        You could encounter cases where you can't find the data of the fields you have to extract or the data will be in a foreign language.
                        Please process the following text and provide the output in pure JSON format with no words before or after the JSON:
    Please ensure the output strictly follows this schema:

    {
        "listings": [
            {
                FIELDS
            }
        ]
    } """
MAPPING_SYSTEM_TEXT = """
    You are an intelligent assistant that helps clean and organize data.
    Given these column names, please suggest merged or unified columns for consistency.
    Provide a unified column mapping and return ONLY the column names as a dictionary in JSON format.
    """
