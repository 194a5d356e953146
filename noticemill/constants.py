"""Results depend on these texts, so they are stated as they are.

Word lists, labels, patterns, thresholds and formats that must equal the known
behaviour. Every job takes them as default parameters.
"""

from __future__ import annotations

# --- missing-value texts -------------------------------------------------------------
MISSING = "原文未明确说明"
NOT_EXTRACTED = "本次未成功提取"
DETAIL_UNAVAILABLE = "详情未获取，无法提取"
EXTRACTION_FAILED = "提取失败，待复核"

# --- sources ---------------------------------------------------------------------------
SOURCE_PRIORITY = {"ccgp": 0, "cebpub": 1, "login_portal": 5, "mock_public": 9}
SOURCE_DISPLAY_NAMES = {
    "ccgp": "中国政府采购网",
    "cebpub": "中国招标投标公共服务平台",
    "login_portal": "登录态招采门户",
    "public_placeholder": "公开源占位",
    "fixture": "演示数据源",
}
DETAIL_STATUS_LABELS = {
    "full": "已核验详情",
    "metadata_only": "仅元数据",
    "failed": "详情失败",
    "needs_human_verification": "待人工验证",
}
DETAIL_STATUS_LONG_LABELS = {
    "full": "已核验公告详情",
    "metadata_only": "仅列表元数据（不作为公告正文）",
    "failed": "详情抓取失败",
    "needs_human_verification": "详情页需人工完成安全验证（系统未绕过）",
}
SOURCE_STATUS_LABELS = {"success": "成功", "failed": "失败", "skipped": "跳过"}
RUN_STATUS_LABELS = {
    "success": "成功（全部请求数据源已完成）",
    "partial": "部分成功（存在失败或跳过的数据源）",
    "failed": "失败",
    "running": "执行中",
}
DETAIL_URL_BASE = "https://ctbpsp.com/#/bulletinDetail"
DETAIL_URL_ROOT = "https://ctbpsp.com/"

# --- filters ---------------------------------------------------------------------------
TENDER_TERMS = ("招标", "采购", "投标", "中标", "询价", "磋商", "谈判", "比选", "邀标", "竞价")
NOISE_TERMS = ("培训班", "广告投放", "招聘会", "政策解读专题", "意见征集无关")
REGION_SUFFIXES = ("省", "市", "自治区", "特别行政区")
SUMMARY_TERMS = ("项目名称", "采购人", "招标人", "采购单位", "预算", "金额", "截止", "地点",
                 "地区", "资格", "包件")
LIST_REASONS = ("非招标/采购类标题", "关键词不匹配", "区域不匹配", "发布时间不在范围内")
DETAIL_REASONS = ("详情非招标/采购类", "详情关键词不匹配", "详情区域不匹配", "详情发布时间不在范围内")

# --- titles, codes, lifecycle -------------------------------------------------------
TITLE_BRACKETS = r"[\[【(（][^\]】)）]*[\]】)）]"
TITLE_PUNCTUATION = r"[，,。．.\-—_：:；;！!？?、/\\|]+"
TITLE_SUFFIXES = ("公开招标公告", "竞争性磋商公告", "竞争性谈判公告", "询价公告", "中标公告",
                  "成交公告", "更正公告", "招标公告", "采购公告", "公告")
CODE_LABELLED = r"(?:项目编号|招标编号|采购编号|公告编号|编号)[:：\s]*([A-Za-z0-9\-_/]{5,40})"
CODE_BARE = r"\b([A-Z]{1,6}\d{4,}[\-A-Za-z0-9]{0,20})\b"
LIFECYCLE_MARKERS = (
    ("终止公告", ("终止公告", "终止招标", "招标终止")),
    ("废标公告", ("废标公告", "流标公告", "采购失败")),
    ("更正公告", ("更正公告", "变更公告", "澄清公告")),
    ("中标公告", ("中标公告", "中标候选人公示", "中标结果")),
    ("成交公告", ("成交公告", "成交结果")),
    ("资格预审", ("资格预审",)),
    ("招标公告", ("招标公告", "采购公告", "磋商公告", "询价公告")),
)
UNKNOWN_TYPE = "未知"
TITLE_SIMILARITY = 0.88
CONTAINED_SIMILARITY = 0.92
CONTAINED_MIN_CHARS = 6
CONTENT_SIMILARITY = 0.75
CONTENT_SIMILARITY_SHOWN = 0.55
SIMILARITY_CHARS = 1500

# --- regions ---------------------------------------------------------------------------
REGION_ALIASES = {
    "北京市": ["北京", "北京市", "京"],
    "天津市": ["天津", "天津市", "津"],
    "上海市": ["上海", "上海市", "沪"],
    "重庆市": ["重庆", "重庆市", "渝"],
    "河北省": ["河北", "河北省", "冀"],
    "山西省": ["山西", "山西省", "晋"],
    "辽宁省": ["辽宁", "辽宁省", "辽"],
    "吉林省": ["吉林", "吉林省"],
    "黑龙江省": ["黑龙江", "黑龙江省", "黑"],
    "江苏省": ["江苏", "江苏省", "苏"],
    "浙江省": ["浙江", "浙江省", "浙"],
    "安徽省": ["安徽", "安徽省", "皖"],
    "福建省": ["福建", "福建省", "闽"],
    "江西省": ["江西", "江西省", "赣"],
    "山东省": ["山东", "山东省", "鲁"],
    "河南省": ["河南", "河南省", "豫"],
    "湖北省": ["湖北", "湖北省", "鄂"],
    "湖南省": ["湖南", "湖南省", "湘"],
    "广东省": ["广东", "广东省", "粤"],
    "海南省": ["海南", "海南省", "琼"],
    "四川省": ["四川", "四川省", "川", "蜀"],
    "贵州省": ["贵州", "贵州省", "黔", "贵"],
    "云南省": ["云南", "云南省", "滇", "云"],
    "陕西省": ["陕西", "陕西省", "陕", "秦"],
    "甘肃省": ["甘肃", "甘肃省", "甘", "陇"],
    "青海省": ["青海", "青海省", "青"],
    "台湾省": ["台湾", "台湾省", "台"],
    "内蒙古自治区": ["内蒙古", "内蒙古自治区", "内蒙"],
    "广西壮族自治区": ["广西", "广西壮族自治区", "广西省"],
    "西藏自治区": ["西藏", "西藏自治区"],
    "宁夏回族自治区": ["宁夏", "宁夏回族自治区"],
    "新疆维吾尔自治区": ["新疆", "新疆维吾尔自治区"],
    "香港特别行政区": ["香港", "香港特别行政区", "港"],
    "澳门特别行政区": ["澳门", "澳门特别行政区", "澳"],
    "合肥市": ["合肥", "合肥市"],
    "南京市": ["南京", "南京市"],
    "杭州市": ["杭州", "杭州市"],
    "苏州市": ["苏州", "苏州市"],
    "深圳市": ["深圳", "深圳市"],
    "广州市": ["广州", "广州市"],
    "成都市": ["成都", "成都市"],
    "武汉市": ["武汉", "武汉市"],
    "西安市": ["西安", "西安市"],
    "厦门市": ["厦门", "厦门市"],
    "青岛市": ["青岛", "青岛市"],
    "大连市": ["大连", "大连市"],
    "宁波市": ["宁波", "宁波市"],
    "郑州市": ["郑州", "郑州市"],
    "长沙市": ["长沙", "长沙市"],
}
PROVINCE_NAMES = (
    "北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江",
    "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "海南", "四川", "贵州",
    "云南", "陕西", "甘肃", "青海", "台湾", "内蒙古", "广西", "西藏", "宁夏", "新疆", "香港",
    "澳门",
)

# --- pages -----------------------------------------------------------------------------
DROP_TAGS = ("script", "style", "nav", "footer", "header", "aside", "iframe", "noscript",
             "form", "button")
DROP_CLASS_WORDS = ("nav", "menu", "footer", "header", "sidebar", "advert", "ad-", "share",
                    "breadcrumb", "login", "copyright", "recommend", "related", "toolbar",
                    "sitenav")
MAIN_CONTAINERS = ("#mainContent", ".vF_detail_content", ".vF_detail_content_container",
                   "#content", ".content", "article")
ATTACHMENT_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".wps")
ATTACHMENT_WORDS = ("附件", "下载", "招标文件", "采购文件")
ATTACHMENT_KEY_PATTERN = r"attachment|annex|accessory|file|附件|附档"
LIST_REGION_MARKS = ("省", "市", "区", "县")
NAVIGATION_WORDS = ("登录", "注册", "首页", "下载客户端", "APP")
ANCHOR_TERMS = ("招标", "采购", "中标", "询价", "磋商", "投标")
RATE_LIMIT_MARKERS = ("您的访问过于频繁", "频繁访问")
VERIFY_MARKERS = ("安全验证", "人机验证", "请完成验证", "验证码", "拖动滑块", "访问过于频繁",
                  "captcha")
UPLOAD_MAX_BYTES = 20 * 1024 * 1024
UPLOAD_MAX_CHARS = 2_000_000

# --- field extraction ------------------------------------------------------------------
PURCHASER_LABELS = ("采购人名称", "招标人名称", "采购人（招标人）", "招标人（采购人）", "采购人",
                    "招标人", "采购单位", "建设单位", "招标单位", "甲方")
EXPLICIT_PURCHASER_LABELS = ("采购人名称", "采购人", "采购单位")
TENDERER_LABELS = ("招标人名称", "招标人", "项目业主", "建设单位", "招标单位")
AGENCY_LABELS = ("招标代理机构", "采购代理机构", "委托代理机构", "代理机构")
PLATFORM_LABELS = ("交易平台", "电子招标投标交易平台", "发布媒介")
FUNDING_LABELS = ("项目资金来源", "资金来源")
PRICE_LABELS = ("招标文件每套售价", "文件售价", "招标文件售价")
NOTICE_END_LABELS = ("公告结束时间", "公告截止时间")
BID_DEADLINE_LABELS = ("投标文件递交的截止时间", "投标截止时间", "递交投标文件截止时间", "投标截止")
OPENING_LABELS = ("开标时间", "开标日期")
QUALIFICATION_LABELS = ("投标人的资格要求", "投标人资格要求", "投标人资格能力要求", "投标人资格",
                        "供应商资格要求", "供应商资格条件", "供应商资格", "资格要求",
                        "申请人资格条件", "申请人资格要求", "资格条件")
PURCHASER_PATTERN = (r"(?:采购人名称|招标人名称|采购人|招标人|采购单位|建设单位|甲方|招标单位)"
                     r"[：:\s]*([^\n。；;]{2,80})")
AGENCY_PATTERN = (r"(?:招标代理机构|采购代理机构|委托代理机构|代理机构)"
                  r"[：:\s]*([^\n。；;]{2,80})")
CODE_PATTERN = (r"(?:项目编号|招标编号|采购编号|公告编号|标段编号)"
                r"[：:\s]*([A-Za-z0-9\-_／/（）()]{4,64})")
BUDGET_PATTERN = (r"(?:预算金额|采购预算|预算金额为|预算为|最高限价|控制价|项目预算)"
                  r"[：:\s]*([0-9]+(?:\.[0-9]+)?\s*(?:万元|亿元|元|万)?|[^\n。；;]{2,40})")
DEADLINE_PATTERN = (r"(?:投标文件递交的截止时间|投标截止时间|投标截止|递交投标文件截止时间|"
                    r"响应文件递交截止时间|响应截止时间)[：:\s]*([^\n。；;]{4,40})")
REGION_PATTERN = (r"(?:项目所在地|交货地点|建设地点|采购地点|项目地点|行政区划|区域|所属地区|项目区域)"
                  r"[：:\s]*([^\n。；;]{2,40})")
CONTENT_PATTERN = (r"(?:采购内容|项目内容|招标内容|采购项目名称|项目概况)"
                   r"[：:\s]*([^\n]{4,200})")
TYPE_PATTERN = (r"(公开招标|邀请招标|竞争性磋商|竞争性谈判|询价|单一来源|中标公告|成交公告|"
                r"更正公告|终止公告|废标公告|资格预审|入围采购|招标公告)")
QUALIFICATION_PATTERN = (r"(?:投标人的资格要求|投标人资格要求|投标人资格能力要求|投标人资格|"
                         r"供应商资格要求|供应商资格条件|供应商资格|资格要求|申请人资格条件|"
                         r"申请人资格要求|资格条件)[：:\s]*([^\n]{4,300})")
PROJECT_NAME_PATTERN = r"(?:项目名称|采购项目)[：:\s]*([^\n]{4,120})"
BODY_NAME_PATTERN = r"项目名称[：:\s]*([^\n]{4,120})"
NOT_A_NAME = ("招标公告", "采购公告", "中标公告", "公告")
CONTENT_TITLE_SUFFIX = r"(公开招标公告|招标公告|中标公告|采购公告|成交公告)\z"
SHORT_TITLE_SUFFIX = r"(公开招标公告|招标公告|中标公告|成交公告|更正公告)\z"
ENTRUSTED_AGENCY_PATTERN = (r"([^\n，,。；;]{2,80}?(?:有限责任公司|股份有限公司|有限公司|事务所|招标中心))"
                            r"\s*受招标人委托")
FUNDING_PATTERN = (r"(建设资金及出资比例|建设资金|资金来源)\s*(?:为|[：:])?\s*"
                   r"((?:国有资金|财政资金|企业自筹|自筹资金|银行贷款|其他资金)[^\n，,。；;]{0,60})")
PRICE_PATTERN = (r"(招标文件每套售价|招标文件售价|文件售价)(?:人民币)?\s*([（(](?:元|万元)[）)])?"
                 r"\s*(?:为|[：:])?\s*(\d+(?:\.\d+)?)\s*(万元|元)?")
DATE_VALUE = (r"20\d{2}\s*[年\-/]\s*\d{1,2}\s*[月\-/]\s*\d{1,2}日?"
              r"(?:\s*\d{1,2}\s*[时:]\s*\d{1,2}\s*分?)?")
ACQUISITION_PATTERN = (r"(招标文件的获取|获取招标文件|招标文件获取时间)[^\n]{0,80}?(" + DATE_VALUE +
                       r")\s*(?:至|到|~|—)\s*(" + DATE_VALUE + ")")
DATETIME_PARTS = (r"(20\d{2})[年\-/](\d{1,2})[月\-/](\d{1,2})日?"
                  r"(?:[T\s]*(\d{1,2})[时:](\d{1,2})(?:分)?)?")
PUBLISH_LINE_PATTERN = r"公告发布时间[：:\s]*([^\n]{8,20})"
SECTION_STOP = (r"^\s*(?:项目名称|项目编号|招标人(?:名称)?|采购人(?:名称)?|招标代理(?:机构)?|"
                r"采购代理(?:机构)?|预算(?:金额)?|最高限价|投标截止|开标时间|公告(?:发布)?时间|"
                r"联系方式|获取招标文件|递交投标文件|公告正文|一、|二、|三、|四、)")
SECTION_NEXT_HEADING = r"^\s*[4-9][.、．]\s*\S"
PAGE_MARKER = r"【第(\d+)页】"
SECTION_MAX_LINES = 40
SECTION_MAX_CHARS = 5000
TOP_CLAUSE = r"(?m)^\s*\d+\.\d+(?:\.\d+)?(?:[、．.]|\s)"
FRAGMENT_SPLIT = r"\n+|(?=(?:\d+[、．]|（\d+）|\(\d+\)))"
JOINT_VENTURE_NO = r"(?:不接受|不允许).{0,12}联合体|联合体投标.{0,12}(?:不接受|不允许)"
AGENT_YES = r"允许.{0,15}(代理商|代理人)|(代理商|代理人).{0,15}允许"
AGENT_NO = r"不接受.{0,15}(代理商|代理人)"
PLATFORM_YES = r"平台.{0,20}(注册|登记)|(注册|登记).{0,20}平台"
CA_YES = r"(?i)\bCA\b|数字证书|电子签章"
TITLE_COMPANY = (r"^(.+?(?:股份有限公司|有限责任公司|有限公司|集团有限公司))"
                 r".{0,60}(?:采购|招标|询价|磋商|入围)")
TITLE_ORGANISATION = (r"^(.+?(?:集团公司|集团|大学|医院|中心|银行股份有限公司|银行|管理局|局|厅|委员会|部))"
                      r".{0,60}(?:采购|招标|询价|磋商|入围)")
TITLE_INFERRED = "标题推断"
SPACED_PURCHASER = r"(采\s*购\s*人(?:\s*名\s*称)?|招\s*标\s*人(?:\s*名\s*称)?)"
SPACED_VALUE = r"^\s*(?:[：:]|为|是)?\s*([^\n，,。；;]{2,120})"
REJECTED_PREFIXES = ("资格", "要求", "地址", "联系方式", "联系人", "代理", "委托")
DETAIL_ONLY_FIELDS = (
    "purchaser", "purchaser_source_label", "tenderer", "tenderer_source_label", "agency",
    "budget", "document_price", "funding_source", "deadline", "bid_deadline", "opening_time",
    "document_acquisition_start", "document_acquisition_end", "qualification",
    "joint_venture_allowed", "agent_allowed", "platform_registration_required", "ca_required",
)
PROPOSABLE_FIELDS = (
    "purchaser", "tenderer", "agency", "transaction_platform", "project_code", "budget",
    "document_price", "funding_source", "notice_end_time", "document_acquisition_start",
    "document_acquisition_end", "bid_deadline", "opening_time", "qualification",
)
CORRECTABLE_FIELDS = (
    "purchaser", "purchaser_source_label", "tenderer", "tenderer_source_label", "agency",
    "transaction_platform", "project_code", "budget", "document_price", "funding_source",
    "notice_end_time", "document_acquisition_start", "document_acquisition_end", "bid_deadline",
    "deadline", "opening_time", "region", "content", "announcement_type", "qualification",
    "qualification_items", "joint_venture_allowed", "agent_allowed",
    "platform_registration_required", "ca_required",
)
CORE_FIELDS = ("purchaser", "region", "project_code", "budget", "deadline", "content",
               "publish_time_cn")
QUOTE_CHARS = 6000
CHUNK_CHARS = 18_000

# --- decisions -------------------------------------------------------------------------
RESULT_TYPES = ("中标公告", "成交公告", "废标公告")
CLOSED_TYPES = ("中标公告", "成交公告", "废标公告", "终止公告")
TOKEN_STOPWORDS = ("投标人", "本次招标", "应当", "必须", "要求", "具备", "提供")
TOKEN_PATTERN = r"[A-Za-z]{2,}|[\x{4e00}-\x{9fff}]{2,8}"
NOTE_FORBIDDEN = r"(?:预算|金额|万元|亿元|联系人|必然中标|中标概率)"
SUMMARY_FORBIDDEN = r"(?:预算|金额|万元|亿元|联系人|中标概率)"
PRIORITY_RANK = {"高": 4, "中": 3, "待核验": 2, "低": 1}
PRIORITY_ORDER = ("高", "中", "待核验", "低")

# --- login pages -----------------------------------------------------------------------
LOGIN_WALL_MARKERS = ("请登录", "登录后查看", "立即登录", "用户登录", "会员登录")
LOGGED_IN_MARKERS = ("退出登录", "安全退出", "个人中心", "我的账号", "注销")
