"""They must be exactly these for results to be right."""

from __future__ import annotations

# Terms by category. A term counts once per text, as a case-insensitive substring.
GREEN = [
    "green", "eco", "environment", "sustainable", "sustainability", "carbon", "emission", "net zero", "climate", "renewable", "recyclable",
    "biodegradable", "circular", "zero waste", "low-carbon", "decarbonization", "decarbonisation", "clean energy", "energy efficient",
    "emissions reduction", "climate positive", "绿色", "环保", "可持续", "低碳", "碳中和", "净零", "减排", "排放", "气候", "可再生", "回收", "循环", "降解", "节能",
    "清洁能源", "绿色生产", "绿色供应链", "绿色包装", "节水", "生态", "esg",
]
VAGUE = [
    "aim", "strive", "committed to", "leading", "greener", "eco-friendly", "planet-friendly", "minimize impact", "sustainable future",
    "responsible choice", "better for the planet", "nature positive", "conscious", "cleaner future", "low impact", "致力于", "努力", "持续推进", "绿色未来",
    "更绿色", "更环保", "环境友好", "显著", "有效", "积极", "全面", "助力", "打造", "引领", "不断", "守护地球", "绿色生活", "自然之选", "低影响",
]
ABSOLUTE = [
    "100%", "zero emissions", "carbon neutral", "net zero", "no environmental impact", "planet positive", "completely sustainable",
    "all natural", "fully green", "best in class", "guilt-free", "零排放", "碳中和", "净零", "无污染", "对环境无影响", "完全可持续", "百分百环保", "全部使用", "行业领先", "最环保",
]
PROOF = [
    "third-party", "verified", "certified", "audited", "assurance", "iso", "gri", "sbti", "cdp", "lca", "life cycle", "methodology",
    "science based", "independently verified", "第三方", "核证", "认证", "审计", "鉴证", "生命周期", "方法学", "数据来源", "科学碳目标", "独立验证",
]
FUTURE = [
    "will", "plan to", "pledge", "target", "roadmap", "by 2030", "by 2050", "commitment", "ambition", "goal",
    "将", "计划", "承诺", "目标", "路线图", "到2030", "到2050", "未来", "愿景",
]
EMOTIONAL = [
    "next generation", "our children", "for our children", "for the planet", "for future generations", "guilt-free", "responsible choice",
    "save the planet", "climate emergency", "last chance", "future generations", "为了子孙", "下一代", "我们的孩子", "共同责任", "守护地球", "你的选择", "从我做起",
    "绿色未来", "美好家园", "引领变革", "刻不容缓", "迫在眉睫", "气候紧急", "最后机会",
]
ACTION = [
    "reduced", "achieved", "implemented", "installed", "replaced", "invested", "measured", "reported", "purchased renewable", "completed",
    "cut emissions", "transitioned", "已", "已经", "完成", "减少了", "降低了", "实施", "安装", "替换", "投入", "采购", "披露", "核算", "转型",
]
SCOPE = ["scope 1", "scope 2", "scope 3", "baseline", "base year", "范围一", "范围二", "范围三", "基准年", "边界", "产品边界", "组织边界"]
LEXICON = {"green": GREEN, "vague": VAGUE, "absolute": ABSOLUTE, "proof": PROOF, "future": FUTURE, "emotional": EMOTIONAL, "action": ACTION, "scope": SCOPE}

# Signal terms of the kinds of text, in declared order.
CONTEXTS = {
    "marketing": ["buy", "shop", "campaign", "brand", "customers", "choice", "launch", "series", "collection", "限时", "新品", "品牌", "消费者", "选择", "系列", "活动", "购买", "打造"],
    "product": ["product", "packaging", "materials", "ingredient", "sku", "bottle", "label", "产品", "包装", "材料", "成分", "面料", "瓶身", "可回收包装"],
    "report": ["annual report", "sustainability report", "esg report", "scope 1", "scope 2", "scope 3", "gri", "tcfd", "cdp", "assurance", "disclosure", "年度报告", "可持续发展报告", "esg报告", "范围一", "范围二", "范围三", "披露", "审计", "鉴证"],
    "social": ["#", "@", "post", "tweet", "instagram", "linkedin", "follow", "share", "转发", "点赞", "微博", "小红书", "公众号", "关注"],
    "press_release": ["press release", "news release", "announcement", "pr newswire", "新闻稿", "公告", "发布", "宣布", "正式推出", "即日起"],
    "investor_relations": ["investor", "shareholder", "annual report", "sec filing", "10-k", "10-q", "earnings call", "dividend", "投资者", "股东", "年报", "财报", "业绩", "上市", "港交所", "纽交所", "纳斯达克"],
    "policy": ["regulation", "compliance", "law", "directive", "legislation", "regulatory", "法规", "政策", "合规", "条例", "监管", "国家标准", "行政"],
    "employer_branding": ["career", "join us", "workplace", "employee", "diversity inclusion", "great place to work", "招聘", "雇主", "员工", "团队", "文化", "价值观", "人才", "加入我们", "职场"],
}
# Signal terms of the sectors, in declared order.
SECTORS = {
    "energy": ["oil", "gas", "coal", "fuel", "refinery", "solar", "wind", "hydrogen", "battery", "grid", "petrochemical", "石油", "天然气", "煤", "燃料", "炼化", "光伏", "风电", "氢能", "电池", "电网", "化工"],
    "fashion": ["fashion", "clothing", "apparel", "garment", "textile", "cotton", "polyester", "鞋", "服装", "服饰", "纺织", "面料", "棉", "涤纶", "门店"],
    "aviation": ["airline", "flight", "aviation", "airport", "cargo", "shipping", "logistics", "fleet", "航空", "航班", "机场", "物流", "运输", "货运", "船运", "车队"],
    "manufacturing": ["factory", "manufacturing", "plant", "production line", "supply chain", "steel", "cement", "aluminum", "工厂", "制造", "生产线", "供应链", "钢铁", "水泥", "铝", "产能"],
    "finance": ["bank", "fund", "loan", "investment", "portfolio", "insurance", "asset", "green bond", "银行", "基金", "贷款", "投资", "组合", "保险", "资产", "绿色债券"],
    "technology": ["software", "cloud", "data center", "ai", "server", "chip", "device", "platform", "软件", "云", "数据中心", "人工智能", "服务器", "芯片", "设备", "平台"],
    "food_agriculture": ["farm", "agriculture", "crop", "livestock", "fertilizer", "pesticide", "organic", "food", "beverage", "dairy", "meat", "grain", "农业", "食品", "饮料", "种植", "畜牧", "有机", "化肥", "农药", "乳品", "粮食", "渔业"],
    "construction_realestate": ["building", "construction", "real estate", "property", "green building", "leed", "breeam", "建筑", "房地产", "物业", "开发", "楼盘", "建材", "绿色建筑", "装修"],
    "automotive": ["automotive", "vehicle", "car", "electric vehicle", "ev", "charging", "fleet", "汽车", "车辆", "电动", "充电", "轿车", "商用车"],
    "consumer_goods": ["consumer goods", "household", "detergent", "cosmetics", "personal care", "shampoo", "toiletry", "消费品", "日化", "洗护", "清洁", "化妆品", "个人护理", "家居"],
    "healthcare": ["pharmaceutical", "healthcare", "hospital", "medical", "drug", "clinical", "patient", "biotech", "医药", "医疗", "制药", "医院", "临床", "患者", "健康"],
}
HIGH_IMPACT = ["energy", "fashion", "aviation", "manufacturing"]

# Certificates (id, English name, Chinese name, type, region, domains, year, pattern).
CERTIFICATES = [
    ("iso_14001", "ISO 14001 Environmental Management", "ISO 14001 环境管理体系", "management_system", "global", ["environment", "management_system"], 1996, r"ISO\s*14001"),
    ("iso_14064", "ISO 14064 GHG Accounting", "ISO 14064 温室气体核算", "process", "global", ["ghg", "carbon"], 2006, r"ISO\s*14064(-[123])?"),
    ("iso_14067", "ISO 14067 Product Carbon Footprint", "ISO 14067 产品碳足迹", "product", "global", ["carbon", "lca", "product"], 2013, r"ISO\s*14067"),
    ("iso_50001", "ISO 50001 Energy Management", "ISO 50001 能源管理体系", "management_system", "global", ["energy", "management_system"], 2011, r"ISO\s*50001"),
    ("pas_2050", "PAS 2050 Product GHG LCA", "PAS 2050 产品生命周期温室气体评估", "product", "global", ["carbon", "lca", "product"], 2008, r"PAS\s*2050"),
    ("ghg_protocol", "GHG Protocol Corporate Standard", "温室气体核算体系", "reporting_framework", "global", ["ghg", "carbon", "framework"], 2001, r"GHG\s*Protocol|温室气体核算体系"),
    ("sbti", "Science Based Targets initiative", "科学碳目标倡议", "initiative", "global", ["carbon", "targets", "validation"], 2015, r"\bSBTi\b|science[\s-]based\s+targets?|科学碳目标"),
    ("re100", "RE100 100% Renewable Electricity", "RE100 百分百可再生能源倡议", "initiative", "global", ["renewable", "energy"], 2014, r"\bRE100\b"),
    ("cdp", "CDP Disclosure", "CDP 气候披露项目", "reporting_framework", "global", ["climate", "water", "forests", "disclosure"], 2000, r"\bCDP\b"),
    ("tcfd", "TCFD", "TCFD 气候相关财务披露", "reporting_framework", "global", ["climate", "financial_disclosure"], 2015, r"\bTCFD\b"),
    ("tnfd", "TNFD", "TNFD 自然相关披露", "reporting_framework", "global", ["biodiversity", "nature", "disclosure"], 2021, r"\bTNFD\b"),
    ("issb_s1_s2", "ISSB IFRS S1/S2", "ISSB IFRS S1/S2 可持续披露准则", "reporting_framework", "global", ["disclosure", "climate", "financial"], 2021, r"ISSB|IFRS\s*S[12]"),
    ("gri", "GRI Standards", "GRI 全球报告倡议", "reporting_framework", "global", ["esg", "reporting"], 1997, r"\bGRI\b"),
    ("sasb", "SASB Standards", "SASB 可持续会计准则", "reporting_framework", "global", ["esg", "reporting", "financial"], 2011, r"\bSASB\b"),
    ("iirc", "IIRC Integrated Reporting", "国际整合报告框架", "reporting_framework", "global", ["esg", "reporting"], 2010, r"\b<IR>\b|integrated\s+reporting|IIRC"),
    ("fsc", "FSC Certified", "FSC 森林管理委员会认证", "product", "global", ["forestry", "materials"], 1993, r"\bFSC[\s-]*(certified|认证)?\b"),
    ("pefc", "PEFC Certified", "PEFC 森林认证体系", "product", "global", ["forestry", "materials"], 1999, r"\bPEFC\b"),
    ("rspo", "RSPO Certified", "RSPO 可持续棕榈油认证", "product", "global", ["agriculture", "palm_oil"], 2004, r"\bRSPO\b"),
    ("c2c", "Cradle to Cradle Certified", "Cradle to Cradle 摇篮到摇篮认证", "product", "global", ["circular_economy", "materials", "product"], 2010, r"cradle[\s-]to[\s-]cradle|\bC2C\b"),
    ("bcorp", "B Corporation", "B Corp 共益企业认证", "management_system", "global", ["esg", "governance", "social"], 2006, r"\bB\s*Corp(oration)?\b|B\s+Lab\s+certified"),
    ("fairtrade", "Fairtrade", "Fairtrade 公平贸易认证", "product", "global", ["social", "agriculture"], 1997, r"\bFairtrade\b"),
    ("rainforest_alliance", "Rainforest Alliance Certified", "Rainforest Alliance 雨林联盟认证", "product", "global", ["agriculture", "biodiversity", "forestry"], 1987, r"Rainforest\s+Alliance"),
    ("msc", "MSC Certified", "MSC 海洋管理委员会认证", "product", "global", ["seafood", "fishery"], 1997, r"\bMSC\b\s+(certified|认证)?"),
    ("asc", "ASC Certified", "ASC 水产管理委员会认证", "product", "global", ["seafood", "aquaculture"], 2010, r"\bASC\b\s+(certified|认证)?"),
    ("usda_organic", "USDA Organic", "USDA 美国农业部有机认证", "product", "us", ["agriculture", "organic"], 2002, r"USDA\s+Organic"),
    ("eu_organic", "EU Organic", "欧盟有机认证", "product", "eu", ["agriculture", "organic"], 2010, r"EU\s+Organic|Euroleaf"),
    ("oekotex", "OEKO-TEX Standard 100", "OEKO-TEX 纺织品安全认证", "product", "global", ["textile", "chemical_safety"], 1992, r"OEKO[\s-]?TEX|Standard\s+100"),
    ("gots", "GOTS", "GOTS 全球有机纺织品标准", "product", "global", ["textile", "organic"], 2008, r"\bGOTS\b"),
    ("bci", "Better Cotton Initiative", "良好棉花发展协会 BCI", "initiative", "global", ["agriculture", "textile", "cotton"], 2009, r"Better\s+Cotton|\bBCI\b"),
    ("rspca_assured", "RSPCA Assured", "RSPCA Assured 动物福利认证", "product", "uk", ["animal_welfare", "food"], 1994, r"RSPCA\s+Assured"),
    ("leed", "LEED Certified", "LEED 绿色建筑认证", "product", "global", ["buildings", "energy"], 1998, r"\bLEED\b\s+(certified|认证|Gold|Silver|Platinum)?"),
    ("breeam", "BREEAM", "BREEAM 建筑环境评估", "product", "global", ["buildings", "energy"], 1990, r"\bBREEAM\b"),
    ("well", "WELL Building Standard", "WELL 健康建筑标准", "product", "global", ["buildings", "health"], 2014, r"WELL\s+(Building|certified|认证)"),
    ("passive_house", "Passive House (Passivhaus)", "Passive House 被动房标准", "product", "global", ["buildings", "energy"], 1996, r"Passive\s+House|Passivhaus"),
    ("energy_star", "ENERGY STAR", "Energy Star 能源之星", "product", "us", ["energy", "product"], 1992, r"ENERGY\s+STAR"),
    ("isae_3000", "ISAE 3000", "ISAE 3000 非财务信息鉴证", "assurance", "global", ["assurance", "non_financial"], 2003, r"ISAE\s*3000"),
    ("isae_3410", "ISAE 3410 GHG Assurance", "ISAE 3410 温室气体鉴证", "assurance", "global", ["assurance", "ghg"], 2012, r"ISAE\s*3410"),
    ("aa1000", "AA1000 AccountAbility", "AA1000 责任管理标准", "assurance", "global", ["stakeholder", "assurance", "esg"], 1999, r"AA1000(AS|APS|SES)?"),
    ("iso_19011", "ISO 19011 Auditing Guidelines", "ISO 19011 审计指南", "process", "global", ["audit", "management_system"], 2002, r"ISO\s*19011"),
    ("un_global_compact", "UN Global Compact", "联合国全球契约", "initiative", "global", ["governance", "ethics", "esg"], 2000, r"UN\s+Global\s+Compact|UNGC"),
    ("pri", "Principles for Responsible Investment", "PRI 责任投资原则", "initiative", "global", ["investment", "esg"], 2006, r"\bPRI\b\s+signatory|Principles\s+for\s+Responsible\s+Investment"),
    ("ev100", "EV100", "EV100 电动汽车倡议", "initiative", "global", ["transport", "electric_vehicles"], 2017, r"\bEV100\b"),
]

# Who issues each certificate, and where it is looked up.
CERTIFICATE_SOURCES = [
    ("iso_14001", "International Organization for Standardization", "https://www.iso.org/iso-14001-environmental-management.html"),
    ("iso_14064", "International Organization for Standardization", "https://www.iso.org/standard/66453.html"),
    ("iso_14067", "International Organization for Standardization", "https://www.iso.org/standard/71206.html"),
    ("iso_50001", "International Organization for Standardization", "https://www.iso.org/iso-50001-energy-management.html"),
    ("pas_2050", "British Standards Institution", "https://www.bsigroup.com/en-GB/standards/pas-2050/"),
    ("ghg_protocol", "WRI / WBCSD", "https://ghgprotocol.org/corporate-standard"),
    ("sbti", "CDP / UNGC / WRI / WWF", "https://sciencebasedtargets.org/"),
    ("re100", "Climate Group / CDP", "https://www.there100.org/"),
    ("cdp", "CDP", "https://www.cdp.net/"),
    ("tcfd", "Financial Stability Board", "https://www.fsb-tcfd.org/"),
    ("tnfd", "TNFD", "https://tnfd.global/"),
    ("issb_s1_s2", "IFRS Foundation", "https://www.ifrs.org/groups/international-sustainability-standards-board/"),
    ("gri", "Global Reporting Initiative", "https://www.globalreporting.org/"),
    ("sasb", "Value Reporting Foundation / IFRS", "https://sasb.ifrs.org/"),
    ("iirc", "Value Reporting Foundation / IFRS", "https://www.integratedreporting.org/"),
    ("fsc", "Forest Stewardship Council", "https://fsc.org/"),
    ("pefc", "Programme for the Endorsement of Forest Certification", "https://www.pefc.org/"),
    ("rspo", "Roundtable on Sustainable Palm Oil", "https://rspo.org/"),
    ("c2c", "Cradle to Cradle Products Innovation Institute", "https://www.c2ccertified.org/"),
    ("bcorp", "B Lab", "https://www.bcorporation.net/"),
    ("fairtrade", "Fairtrade International", "https://www.fairtrade.net/"),
    ("rainforest_alliance", "Rainforest Alliance", "https://www.rainforest-alliance.org/"),
    ("msc", "Marine Stewardship Council", "https://www.msc.org/"),
    ("asc", "Aquaculture Stewardship Council", "https://asc-aqua.org/"),
    ("usda_organic", "USDA National Organic Program", "https://www.usda.gov/topics/organic"),
    ("eu_organic", "European Commission", "https://agriculture.ec.europa.eu/farming/organic-farming_en"),
    ("oekotex", "OEKO-TEX Association", "https://www.oeko-tex.com/"),
    ("gots", "Global Organic Textile Standard", "https://global-standard.org/"),
    ("bci", "Better Cotton Initiative", "https://bettercotton.org/"),
    ("rspca_assured", "Royal Society for the Prevention of Cruelty to Animals", "https://www.rspcaassured.org.uk/"),
    ("leed", "U.S. Green Building Council", "https://www.usgbc.org/leed"),
    ("breeam", "BRE Group", "https://bregroup.com/products/breeam/"),
    ("well", "International WELL Building Institute", "https://www.wellcertified.com/"),
    ("passive_house", "Passive House Institute", "https://passivehouse.com/"),
    ("energy_star", "U.S. EPA", "https://www.energystar.gov/"),
    ("isae_3000", "IAASB", "https://www.iaasb.org/publications/international-standard-assurance-engagements-isae-3000-revised"),
    ("isae_3410", "IAASB", "https://www.iaasb.org/publications/international-standard-assurance-engagements-isae-3410-assurance-engagements-greenhouse-gas"),
    ("aa1000", "AccountAbility", "https://www.accountability.org/standards/"),
    ("iso_19011", "International Organization for Standardization", "https://www.iso.org/standard/70017.html"),
    ("un_global_compact", "United Nations", "https://www.unglobalcompact.org/"),
    ("pri", "PRI Association", "https://www.unpri.org/"),
    ("ev100", "Climate Group", "https://www.theclimategroup.org/ev100"),
]


# Signals of false labels (name, severity, pattern). Matched without regard to case.
FALSE_LABELS = [
    ("self_certified", "high", r"self[\s-]certified|self[\s-]declared|our\s+own\s+(?:\w+\s+)?(?:standard|certification|seal)|in[\s-]house\s+(?:cert|standard|verification)|自我认证|自我声明|自定义\s?(?:标准|认证)"),
    ("no_independent_verification", "medium", r"unverified\s+claim|no\s+independent\s+verification|未经(?:独立)?\s?验证|未经审计|自评估"),
    ("unsubstantiated_superlative", "medium", r"(?:industry|market)\s+leader|绝对\s?领先(?:行业)?|行业\s?第一(?!\s*家)|最(?:环保|绿色|可持续)|没有\s?(?:竞争对手|对手)"),
    ("vague_certification_claim", "low", r"\b(?:certified|认证)\b(?!\s+(?:by|to|under|to\s+the|under\s+the|per|against|的|于)\b)"),
]

# Patterns of quantities, dates and scopes.
QUANTITY_V2 = r"\b\d+(\.\d+)?\s?(%|percent|tCO2e|kg|tons?|MWh|GWh|kWh|m³|hectare|acre|百分之|%|吨|千克|公斤|度)"
TIMELINE_V2 = r"\b(19|20)\d{2}\b|by\s+(19|20)\d{2}|到\s?(19|20)\d{2}\s?年"
QUANTITY_V1 = r"\d+(\.\d+)?\s?(%|percent|tco2e|co2e|tonnes?|tons?|kg|kwh|mwh|gwh|mw|gw|公吨|吨|千克|万吨|%|％)"
TIMELINE_V1 = r"20\d{2}|by\s+20\d{2}|fy\s?20\d{2}|到20\d{2}年?|截至20\d{2}年?|在20\d{2}年前"
METRIC = r"(\d+(?:\.\d+)?)\s?(%|percent|tCO2e|kg|tons?|MWh|GWh|kWh|m³|百分之|吨|千克|公斤|度)"
TARGET_YEAR = r"by\s+((?:19|20)\d{2})|到\s?((?:19|20)\d{2})\s?年"
BASELINE_YEAR = r"(?:vs|versus|compared to|since|相比|基准年|baseline)\s*(?:19|20)?(\d{2,4})"
SCOPE_EN, SCOPE_ZH = r"\bscope\s*([123])\b", r"范围\s?([一二三123])"
FUTURE_WORD = r"will|plan|aim|pledge|commit|计划|承诺|将|到\s?20\d{2}"
DONE_WORD = r"reduced|achieved|减少|已"
NET_ZERO = r"net\s*zero|carbon\s*neutral|零排放|碳中和|净零"
CFC_FREE = r"cfc[\s-]*free|无氟利昂"
REFERENCE_INDEX = r"\bread more on pages? \d+"

# Weights of phrases of the Chinese emotion score.
EMOTION_WEIGHTS = {
    "刻不容缓": 3, "生死存亡": 3, "最后机会": 3, "迫在眉睫": 3, "地球危机": 3, "气候紧急": 3, "为了子孙": 2, "下一代": 2, "我们的孩子": 2, "共同责任": 2,
    "守护地球": 2, "你的选择": 2, "从我做起": 2, "绿色未来": 1, "美好家园": 1, "自然之选": 1, "引领变革": 1, "碳排放": 0, "可再生能源": 0, "第三方认证": 0,
}

# Vague words of the text index.
TGRI_VAGUE = [
    "环保", "绿色", "生态", "可持续", "天然", "清洁", "低碳", "零碳", "环境友好", "生态友好", "对地球友好", "负责任", "有机", "无害", "更绿色", "更可持续", "引领变革", "绿色未来",
    "美好家园", "守护地球", "积极推进", "持续优化", "创新脱碳方案", "eco-friendly", "green", "sustainable", "natural", "clean", "low-carbon", "carbon-neutral",
    "net-zero", "climate-friendly", "planet-friendly", "responsible", "environmentally conscious", "biodegradable", "greener", "cleaner future",
    "sustainability-led", "nature positive",
]

# Keywords of the tags that model texts are searched for.
TAG_KEYWORDS = {
    "quantified": ["量化", "指标", "数字", "quant", "metric", "%"],
    "evidence": ["证据", "认证", "审计", "第三方", "evidence", "verified", "audit"],
    "promise": ["承诺", "未来", "2030", "2050", "promise", "future", "target"],
    "absolute": ["绝对", "碳中和", "净零", "zero", "neutral", "net zero"],
    "scope": ["范围", "边界", "基准", "scope", "baseline"],
    "action": ["行动", "实施", "完成", "reduced", "implemented", "completed"],
}

# Severities, components, levels.
SEVERITY_RISK = {"high": 30, "medium": 15, "low": 5}
COMPONENT_WEIGHTS = {"text_risk": 0.30, "evidence_risk": 0.40, "external_risk": 0.15, "consistency_risk": 0.15}
LEVELS = ["低风险", "中低风险", "中高风险", "高风险"]
SINS = ["hidden_tradeoff", "no_proof", "vagueness", "false_labels", "irrelevance"]
