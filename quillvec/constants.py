"""Fixed values that results depend on."""

# --- fixed values: request limits and defaults -------------------------------------------------
MAX_QUERY_CHARS = 1000
MAX_TOP_K = 20
SEARCH_TOP_N, SEARCH_THRESHOLD = 10, 0.3
CHAT_TOP_K, CHAT_THRESHOLD = 4, 0.5
SUGGEST_TOP_K, SUGGEST_THRESHOLD, MIN_SUGGESTIONS = 10, 0.5, 2
HYBRID_TOP_N, HYBRID_THRESHOLD = 10, 0.7
CHAT_SUGGESTION_MIN_MATCHES = 3
CHAT_SUGGESTION_LIMIT = 10
STORE_TOP_K = 4

# --- fixed values: previews and score bands -----------------------------------------------------
SOURCE_PREVIEW_CHARS = 200
SUGGESTION_PREVIEW_CHARS = 300
HIGH_SIMILARITY = 0.8
MEDIUM_SIMILARITY = 0.5

# --- fixed values: chunking and encoding --------------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
ENCODE_BATCH = 50
JDBC_BATCH = 50

# --- fixed values: sheet cleaning ---------------------------------------------------------------
IGNORED_COLUMN_NAMES = ["id", "index", "stt", "no", "unnamed", "nan"]
MIN_ROW_CELLS = 3
DENSITY = 0.1
TEMP_FILE_PREFIX = "~$"

# Date formats tried in this order; bare numbers are not dates.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-M-d",
    "yyyy/M/d",
    "M/d/yyyy",
    "d/M/yyyy",
    "d-M-yyyy",
    "M/d/yyyy H:mm:ss",
    "d/M/yyyy H:mm:ss",
    "d MMM yyyy",
    "MMM d, yyyy",
]

# --- fixed values: catalogue columns ------------------------------------------------------------
PRODUCT_COLUMNS = {
    "ProductId": "string",
    "ProductName": "string",
    "Category": "string",
    "Description": "string",
    "Price": "decimal(18,2)",
    "StockQuantity": "int",
    "LastUpdated": "timestamp",
}
REQUIRED_PRODUCT_COLUMNS = ["ProductId", "ProductName"]
CONTENT_COLUMN_PRIORITY = ["content", "description", "name"]

# --- fixed values: reply texts ------------------------------------------------------------------
UNKNOWN_FILE = "unknown"
FOUND_MESSAGE = "Tìm thấy {n} kết quả khớp"
NOT_FOUND_MESSAGE = "Không tìm thấy kết quả nào"
CHAT_SUGGESTION_MESSAGE = (
    "Tìm thấy {n} kết quả khớp. Bạn có thể chọn các kết quả cụ thể để xem chi tiết."
)
NO_ANSWER_MESSAGE = "Tôi không tìm thấy thông tin liên quan đến câu hỏi của bạn trong tài liệu."
EMPTY_INPUT_MESSAGE = "empty input"
NO_VECTOR_WARNING = "no row has a usable vector"
CONTEXT_LINE = "[{file}, trang {page}]: {content}"
PROMPT_TEMPLATE = """Bạn là một trợ lý AI thông minh. Hãy trả lời câu hỏi dựa trên các đoạn văn bản được cung cấp bên dưới.

Context (các đoạn văn bản liên quan):
{context}

Câu hỏi: {question}

Hướng dẫn:
- Chỉ trả lời dựa trên thông tin có trong context
- Nếu không tìm thấy thông tin trong context, hãy nói rõ "Tôi không tìm thấy thông tin này trong tài liệu"
- Trả lời bằng tiếng Việt nếu câu hỏi là tiếng Việt
- Trả lời ngắn gọn, chính xác và dễ hiểu

Câu trả lời:"""
