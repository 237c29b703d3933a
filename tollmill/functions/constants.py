"""Fixed values of the toll domain. They define results and are not tuned."""

# --- vehicle codes (fixed values) -------------------------------------------
PASSENGER_CODES = ["1", "2", "3", "4"]
TRUCK_CODES = ["11", "12", "13", "14", "15", "16"]
SPECIAL_CODES = ["21", "22", "23", "24", "25", "26"]

PASSENGER = "客车"
TRUCK = "货车"
SPECIAL = "专项车"

# vehicle code -> axle count
EXPECTED_AXLES = {
    1: "2", 2: "2", 3: "2", 4: "2",
    11: "2", 12: "2", 13: "3", 14: "4", 15: "5", 16: "6",
    21: "2", 22: "2", 23: "3", 24: "4", 25: "5", 26: "6",
}

# axle count -> weight limit in kg; any other axle text counts as six axles
AXLE_LIMIT_KG = {"2": 18000, "3": 25000, "4": 31000, "5": 43000, "6": 49000}
DEFAULT_AXLE_LIMIT_KG = 49000

# --- periods of the day (fixed values) --------------------------------------
MORNING_PEAK = "早高峰"
EVENING_PEAK = "晚高峰"
NIGHT = "深夜"
OFF_PEAK = "平峰"
UNKNOWN = "未知"
PERIODS = [MORNING_PEAK, EVENING_PEAK, OFF_PEAK, NIGHT]

# --- toll rates in yuan per km (fixed values) -------------------------------
PASSENGER_RATE = {"1": 0.45, "2": 0.75, "3": 1.05, "4": 1.25}
# four fifths ordinary road, one fifth bridge or tunnel
FREIGHT_RATE = 0.45 * 0.8 + 1.15 * 0.2

# coefficients of the rough fee check (fixed values)
BASE_RATE = 0.45
FEE_COEFFICIENT = {
    "1": 1.0, "2": 1.0, "3": 1.0, "4": 1.0,
    "11": 1.5, "12": 1.5, "13": 2.0, "14": 2.5, "15": 3.0, "16": 3.5,
}
DISCOUNT_SHARE = 0.05

# --- default targets (fixed values) -----------------------------------------
CLASS_TARGET = {TRUCK: 0.6, PASSENGER: 0.4}

# --- issue labels (fixed values) --------------------------------------------
ISSUE_TIME_ORDER = "时间错误"
ISSUE_TIME_LONG = "时间异常"
ISSUE_TIME_FORMAT = "时间格式错误"
ISSUE_FEE = "费用错误"
ISSUE_FEE_FORMAT = "费用字段格式错误"
ISSUE_VEHICLE_FORMAT = "车型格式错误"
ISSUE_AXLE = "车辆逻辑错误"
ISSUE_WEIGHT = "重量异常"
ISSUE_MISSING = "缺失必要字段"
ISSUE_SECTION_DATE = "路段日期映射错误"

# --- status labels (fixed values) -------------------------------------------
STATUS_NORMAL = "正常"
STATUS_ABNORMAL = "异常"
OVERLOADED = "超载"

# --- metric tags and their search words (fixed values) ----------------------
METRIC_TAGS = {
    "hourly-flow": ["流量", "小时", "趋势", "高峰", "监测"],
    "avg-travel-time": ["时间", "效率", "拥堵", "时效", "速度"],
    "avg-toll-fee": ["费用", "成本", "收费", "价格", "通行费"],
    "congestion-index": ["拥堵", "路况", "交通", "堵塞", "指数"],
    "overweight-rate": ["超载", "超重", "合规", "违规", "监管"],
    "discount-rate": ["优惠", "折扣", "减免", "政策"],
    "peak-hours": ["高峰", "繁忙", "时段", "高流量"],
    "avg-axle-count": ["轴数", "车型", "类型", "结构"],
    "lane-utilization": ["车道", "利用率", "容量", "资源"],
    "exit-hourly-flow": ["出口", "流量", "出站"],
    "exit-hourly-flow-k-anonymized": ["k匿名", "隐私", "脱敏", "KACA", "匿名化"],
}
DEFAULT_METRIC_TAGS = ["hourly-flow", "avg-travel-time", "congestion-index"]

# --- audit rules (fixed values) ---------------------------------------------
API_PREFIX = "/api/"
UNAUDITED_PREFIXES = ["/api/audit/", "/static/", "/_debug_toolbar/"]
UNAUDITED_PATHS = [
    "/", "/truck-agent", "/old-index", "/workflow-agent", "/dashboard", "/data-synthesis",
    "/dgm-generation", "/api/health", "/api/list", "/api/test/connection",
]
OPERATION_TYPES = [
    ("/api/agent/query", "AGENT_QUERY"),
    ("/api/ai/sql", "AI_SQL_QUERY"),
    ("/api/agent/smart-query", "SMART_QUERY"),
]
DEFAULT_OPERATION_TYPE = "API_CALL"

# words a guarded query must not contain (fixed values)
BANNED_SQL_WORDS = ["DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "TRUNCATE"]

# --- column sets of a gantry transaction (fixed values) ---------------------
CATEGORICAL_FIELDS = [
    "vehicle_type", "gantry_type", "media_type", "transaction_type",
    "pass_state", "axle_count", "cpu_card_type", "vehicle_sign",
]
NUMERIC_FIELDS = ["pay_fee", "discount_fee", "fee_mileage", "total_weight"]
DATETIME_FIELDS = ["transaction_time", "entrance_time"]
SAMPLE_FIELDS = [
    "gantry_transaction_id", "pass_id", "gantry_id", "section_id", "section_name",
    "transaction_time", "entrance_time", "vehicle_type", "axle_count", "total_weight",
    "vehicle_sign", "gantry_type", "media_type", "transaction_type", "pass_state",
    "cpu_card_type", "pay_fee", "discount_fee", "fee_mileage",
]
# exit columns that may leave in a k-anonymous release
RELEASE_FIELDS = [
    "vehicle_class", "vehicle_plate_color_id", "axis_count", "total_limit", "total_weight",
    "card_type", "pay_type", "pay_card_type", "toll_money", "real_money", "card_pay_toll",
    "discount_type",
]
