"""Rule and factor tables as plain values. All tables in this module are fixed values that results depend on."""

from __future__ import annotations

SCOPES = ("Scope 1", "Scope 2", "Scope 3")

# Ledger path, keyword and tax-code rules in order: scope, prefixes, keywords, excluded words, factor.
LEDGER_RULES = [
    ("Scope 1", ["101", "102", "103"], ["煤炭", "原煤", "洗煤", "型煤"], [], "coal"),
    ("Scope 1", ["104", "105"], ["原油", "天然气", "液化气"], [], "oil_gas"),
    ("Scope 1", ["106"], ["燃气", "煤气", "天然气"], [], "gas"),
    ("Scope 1", ["107", "108"], ["成品油", "汽油", "柴油", "燃料油", "炼焦"], ["沥青", "蜡", "碳黑", "润滑油", "石蜡"], "refined_oil"),
    ("Scope 1", [], ["加油", "车用汽油", "车用柴油"], [], "gasoline_liter"),
    ("Scope 2", ["109", "110"], ["电力", "电费", "热力", "冷气", "供暖", "供热", "冷暖", "空调费"], [], "electricity_heat"),
    ("Scope 3", ["111", "112"], ["自来水", "用水", "水费", "污水", "排水", "给水"], [], "water"),
    ("Scope 3", [], ["锂电池", "蓄电池", "电池组", "电子元件", "电子器件", "半导体", "集成电路", "杜邦线", "DC转换头", "连接器", "模块"], [], "scope3_default"),
    ("Scope 3", [], ["轴承", "角码", "螺丝", "螺母", "螺栓", "固定环", "铝合金", "金属制品", "五金", "零件", "部件", "紧固件"], [], "scope3_default"),
    ("Scope 3", [], ["502强力胶", "强力胶", "胶水", "粘合剂", "化工品", "化学品"], [], "scope3_default"),
    ("Scope 3", [], ["乐高", "积木", "玩具", "套件", "套组"], [], "scope3_default"),
    ("Scope 3", ["304", "305"], ["租赁", "租车", "租设备", "经营性租赁"], [], "scope3_lease"),
    ("Scope 3", ["300", "301", "302", "303"], ["服务", "劳务", "运输", "物流", "快递", "咨询", "IT", "电信", "顺丰", "EMS", "运费", "快递费", "邮费", "打包费", "配送费"], [], "scope3_service"),
    ("Scope 3", [], ["办公用品", "文具", "纸张", "打印耗材", "墨盒", "碳粉", "复印纸", "A4纸", "办公设备"], [], "scope3_office_supply"),
    ("Scope 3", [], ["机票", "航空", "航班", "飞机票", "民航", "国航", "南航", "东航", "空运"], [], "scope3_transport_air"),
    ("Scope 3", [], ["高铁", "动车", "火车票", "铁路", "高速铁路", "城际铁路"], [], "scope3_transport_rail"),
    ("Scope 3", [], ["打车", "出租车", "网约车", "滴滴", "出行费", "交通费", "租车费", "长途汽车", "大巴"], [], "scope3_transport_road"),
    ("Scope 3", [], ["住宿", "酒店", "宾馆", "旅馆", "民宿", "客房", "住房费", "房费"], [], "scope3_accommodation"),
    ("Scope 3", [], ["公交", "地铁", "地铁充值", "公共交通", "通勤补贴", "交通补贴", "月票"], [], "scope3_commute"),
    ("Scope 3", [], ["垃圾清运", "废弃物", "环卫", "垃圾处理", "清洁费", "保洁费"], [], "scope3_waste"),
]
ACCOMMODATION_WORDS = ["住宿", "酒店", "宾馆", "旅馆", "民宿", "客房", "住房费", "房费"]
EXCLUSION_WORDS = ["沥青", "蜡", "碳黑", "润滑油", "石蜡"]
LOGISTICS_SELLERS = ["顺丰", "EMS", "中通", "圆通", "韵达", "德邦", "京东物流"]
DOMESTIC_HOTEL_CITIES = ["北京", "上海", "广州", "深圳", "成都", "杭州", "南京", "武汉", "天津", "重庆", "西安", "长沙", "昆明"]
FLIGHT_WORDS_CN = ["机票", "航班", "登机", "起飞", "到达", "出发", "航空", "飞机", "客运"]
FLIGHT_WORDS_EN = ["ticket", "flight", "air"]

# Words that mark lines that are not goods; dates and authority stamps.
JUNK_WORDS = ["价税合计", "合计（", "合计(", "合计", "小计", "买方信息", "购方名称", "销方名称", "电子发票", "发票号码", "发票代码", "开票日期", "纳税人识别号", "统一社会信用", "国家税务总局", "监制", "防伪税控"]
JUNK_DATE = r"\d{4}(?:年\d{1,2}月\d{1,2}日?|[-/]\d{1,2}[-/]\d{1,2})"
EXTRACTION_WORDS = [
    "合计", "价税合计", "小计", "购买方", "销售方", "购方", "销方", "发票号码", "发票代码", "开票日期", "开票人", "国家税务总局", "监制", "防伪税控", "税率", "单价", "数量", "规格型号", "单位",
    "备注", "收款人", "复核", "税务局", "名称", "项目名称", "社会信用代码", "纳税人识别号", "统一社会信用代码", "电子票", "电子发票", "项目方称", "普通发票",
]
EXTRACTION_DATE = JUNK_DATE + r"|(?<!\d)20[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?!\d)"
TAX_AUTHORITY = r"国家.{0,3}[税报批][务]总[局码构]"
VAT_RATES = [1, 3, 5, 6, 9, 10, 11, 13, 16, 17]

# Ledger path factors: id, scope, unit, kg CO2e per unit.
LEDGER_FACTORS = [
    ("electricity_heat", "Scope 2", "kWh", 0.5777), ("coal", "Scope 1", "t", 2550.0), ("oil_gas", "Scope 1", "t", 3000.0), ("gas", "Scope 1", "m3", 2.0),
    ("refined_oil", "Scope 1", "L", 2.5), ("gasoline_liter", "Scope 1", "L", 2.3), ("water", "Scope 3", "m3", 0.168), ("scope3_default", "Scope 3", "CNY", 0.00015),
    ("scope3_lease", "Scope 3", "CNY", 0.00012), ("scope3_service", "Scope 3", "CNY", 0.00012), ("scope3_office_supply", "Scope 3", "CNY", 0.00015), ("scope3_transport_air", "Scope 3", "CNY", 0.1497),
    ("scope3_transport_rail", "Scope 3", "CNY", 0.0443), ("scope3_transport_road", "Scope 3", "CNY", 0.05047), ("scope3_accommodation", "Scope 3", "晚", 66.52), ("scope3_commute", "Scope 3", "CNY", 0.0443),
    ("scope3_waste", "Scope 3", "CNY", 0.0419), ("waste_cat1_msw", "Scope 3", "t", 0.0), ("waste_cat2_industrial", "Scope 3", "t", 0.0), ("waste_cat3_weee", "Scope 3", "t", 0.0),
    ("waste_cat4_hw", "Scope 3", "t", 0.0), ("waste_cat5_agri", "Scope 3", "t", 0.0),
]
LEDGER_UNITS = {"度": "kWh", "千瓦时": "kWh", "kwh": "kWh", "吨": "t", "升": "L", "l": "L", "立方米": "m3", "m³": "m3", "元": "CNY", "cny": "CNY", "吨(水)": "m3", "t(水)": "m3"}
HOTEL_KG_PER_NIGHT, HOTEL_KG_PER_CNY = 66.52, 0.2036
FLIGHT_KG_DOMESTIC, FLIGHT_KG_INTERNATIONAL = 0.0829, 0.18362
EARTH_RADIUS_KM = 6371.0088
DEFAULT_PRICE = 100.0

# Disposal routes of waste: factor id, ratio, catalogue product.
WASTE_ROUTES = [
    ("waste_cat1_msw", 0.72, "94333X0022023A"), ("waste_cat1_msw", 0.20, "94332X0032013A"), ("waste_cat1_msw", 0.08, "94339X0132017A"),
    ("waste_cat2_industrial", 0.04, "94333X0022023A"), ("waste_cat2_industrial", 0.15, "94332X0032013A"), ("waste_cat2_industrial", 0.81, "94313X0032016A"),
    ("waste_cat3_weee", 0.10, "94333X0022023A"), ("waste_cat3_weee", 0.05, "94332X0032013A"), ("waste_cat3_weee", 0.85, "94313X0032016A"),
    ("waste_cat4_hw", 0.35, "94311X0102022A"), ("waste_cat4_hw", 0.15, "94332X0052013A"), ("waste_cat4_hw", 0.50, "94311X0022022A"),
    ("waste_cat5_agri", 0.10, "94333X0022023A"), ("waste_cat5_agri", 0.02, "94332X0032013A"), ("waste_cat5_agri", 0.88, "94313X0032016A"),
]
WASTE_FACTORS = ["waste_cat1_msw", "waste_cat2_industrial", "waste_cat3_weee", "waste_cat4_hw", "waste_cat5_agri"]

# Matcher path, tax-code prefixes: prefix, scope, description, confidence.
MATCHER_PREFIXES = [
    ("101", 1, "煤炭采选产品", "高"), ("102", 1, "煤炭采选产品", "高"), ("103", 1, "煤炭采选产品", "高"), ("104", 1, "石油和天然气开采产品", "高"), ("105", 1, "石油和天然气开采产品", "高"),
    ("106", 1, "燃气", "高"), ("107", 1, "石油加工、炼焦及核燃料", "高"), ("108", 1, "石油加工、炼焦及核燃料", "高"), ("1", 1, "煤炭采选产品", "中"), ("2", 1, "石油和天然气开采产品", "中"),
    ("3", 1, "燃气", "中"), ("4", 1, "石油加工、炼焦及核燃料", "中"), ("109", 2, "电力、热力、冷气", "高"), ("110", 2, "电力、热力、冷气", "高"), ("5", 2, "电力和热力、冷气", "中"),
    ("6", 3, "农业产品", "中"), ("7", 3, "食品、纺织品、机械设备等", "中"), ("8", 3, "有形动产租赁服务", "中"), ("9", 3, "销售服务、劳务、电信/物流/咨询/IT", "中"), ("300", 3, "服务、劳务", "高"),
    ("301", 3, "服务、劳务", "高"), ("302", 3, "服务、劳务", "高"), ("303", 3, "服务、劳务", "高"), ("304", 3, "有形动产租赁", "高"), ("305", 3, "有形动产租赁", "高"),
]
MATCHER_KEYWORDS = [
    (["煤炭", "原煤", "洗煤", "型煤", "汽油", "柴油", "燃料油", "炼焦", "成品油", "天然气", "煤气", "液化气"], 1),
    (["电力", "电费", "热力", "冷气", "供暖"], 2),
    (["润滑油", "沥青", "蜡", "石蜡", "碳黑"], 3),
    (["服务", "劳务", "运输", "物流", "快递", "咨询", "IT", "电信", "租赁"], 3),
]
# Materials with a physical factor: keywords, factor name, category, unit parts.
PHYSICAL_MATERIALS = [
    (["冷轧", "热轧", "钢板", "钢材", "钢带", "钢铁"], "钢材", "材料", ["吨", "t", "tons"]),
    (["水泥"], "水泥", "材料", ["吨", "t"]),
    (["电", "电力", "电费"], "电力", "电力", ["kWh", "度", "千瓦时"]),
    (["汽油", "柴油", "成品油", "燃料油"], "汽油", "燃料燃烧", ["升", "L", "吨", "t"]),
    (["煤", "原煤", "洗煤"], "原煤", "燃料燃烧", ["吨", "t"]),
    (["天然气", "燃气", "煤气"], "天然气", "燃料燃烧", ["m3", "立方米", "方"]),
]
EEIO_NAMES = [
    (["造纸", "纸制品", "纸浆"], "造纸业"),
    (["钢铁", "钢材", "钢板", "冶金"], "钢铁业"),
    (["水泥", "建材", "混凝土"], "水泥业"),
    (["办公", "文具", "用品", "耗材"], "制造业"),
    (["运输", "物流", "快递", "运费"], "制造业"),
    (["服务", "咨询", "劳务", "维修"], "制造业"),
]
EEIO_INDUSTRIES = {"造纸": "eeio_paper", "造纸业": "eeio_paper", "钢铁": "eeio_steel", "钢铁业": "eeio_steel", "水泥": "eeio_cement", "水泥业": "eeio_cement", "制造业": "eeio_default", "默认": "eeio_default"}
# Built-in factors of the matcher path: id, name, category, sub category, value, unit, year or null.
MATCHER_FACTORS = [
    ("water_supply", "自来水供应排放因子", "用水", "自来水", 0.344, "kgCO2e/m3", 2020),
    ("water_wastewater", "污水处理排放因子", "用水", "污水", 0.272, "kgCO2e/m3", 2020),
    ("fuel_coal", "原煤因子", "燃料燃烧", "煤炭", 2550.0, "kgCO2e/t", None),
    ("fuel_gasoline", "汽油因子", "燃料燃烧", "成品油", 2.3, "kgCO2e/L", None),
    ("fuel_diesel", "柴油因子", "燃料燃烧", "成品油", 2.63, "kgCO2e/L", None),
    ("fuel_natural_gas", "天然气因子", "燃料燃烧", "燃气", 2.0, "kgCO2e/m3", None),
    ("eeio_paper", "造纸业EEIO因子", "EEIO", "造纸", 0.00018, "kgCO2e/CNY", None),
    ("eeio_steel", "钢铁业EEIO因子", "EEIO", "钢铁", 0.00035, "kgCO2e/CNY", None),
    ("eeio_cement", "水泥业EEIO因子", "EEIO", "水泥", 0.00042, "kgCO2e/CNY", None),
    ("eeio_default", "制造业EEIO默认因子", "EEIO", "默认", 0.00015, "kgCO2e/CNY", None),
    ("material_steel", "钢材/钢板物理因子", "材料", "钢材", 2000.0, "kgCO2e/t", None),
    ("material_cement", "水泥物理因子", "材料", "水泥", 720.0, "kgCO2e/t", None),
    ("material_motor", "微型电机/电机物理因子（按台）", "材料", "电机", 6.0, "kgCO2e/个", None),
    ("material_plastic", "塑料物理因子", "材料", "塑料", 3.0, "kgCO2e/kg", None),
    ("material_copper", "铜/铜材物理因子", "材料", "铜", 4.0, "kgCO2e/kg", None),
    ("material_aluminum", "铝/铝材物理因子", "材料", "铝", 10.0, "kgCO2e/kg", None),
]
# Grid factors in kg CO2e per kWh.
GRID_NATIONAL = 0.5777
GRID_REGIONS = {"西南": 0.2472, "西北": 0.5543, "东北": 0.5122, "华东": 0.55, "南方": 0.4042, "华北": 0.6361, "华中": 0.5271}
GRID_IDS = {"华北": "electricity_north_china", "东北": "electricity_northeast", "华东": "electricity_east_china", "华中": "electricity_central_china", "西北": "electricity_northwest", "南方": "electricity_south", "西南": "electricity_southwest"}
GRID_PROVINCES = {
    "黑龙江": 0.5229, "青海": 0.1796, "陕西": 0.6335, "重庆": 0.5581, "辽宁": 0.4878, "贵州": 0.5683, "福建": 0.4211, "甘肃": 0.4471, "湖南": 0.4976, "湖北": 0.4044, "海南": 0.3648, "浙江": 0.4974, "河北": 0.6516, "上海": 0.5737, "云南": 0.1333,
    "河南": 0.5897, "内蒙古": 0.6479, "江西": 0.5836, "江苏": 0.5827, "新疆": 0.6021, "广西": 0.4476, "广东": 0.4419, "山西": 0.6634, "山东": 0.6191, "安徽": 0.6553, "宁夏": 0.6187, "天津": 0.6796, "四川": 0.1564, "吉林": 0.4671, "北京": 0.5554,
}
# Provinces in the order they are looked for, then regions by other names.
PROVINCE_GRIDS = {
    "北京": "华北", "天津": "华北", "河北": "华北", "山西": "华北", "内蒙古": "华北", "辽宁": "东北", "吉林": "东北", "黑龙江": "东北", "上海": "华东", "江苏": "华东", "浙江": "华东", "安徽": "华东", "福建": "华东", "江西": "华东", "山东": "华东", "河南": "华中",
    "湖北": "华中", "湖南": "华中", "广东": "南方", "广西": "南方", "海南": "南方", "重庆": "华中", "四川": "西南", "贵州": "南方", "云南": "南方", "西藏": "西南", "陕西": "西北", "甘肃": "西北", "青海": "西北", "宁夏": "西北", "新疆": "西北",
}
REGION_NAMES = [(["华北", "京津冀"], "华北"), (["华东", "江浙沪"], "华东"), (["华南", "珠三角", "粤港澳"], "南方"), (["华中"], "华中"), (["东北"], "东北"), (["西北"], "西北"), (["西南"], "西南")]

# Scene factors, in the unit of the source: t or kg CO2e per 10,000 CNY, and litres by kg per tonne and kg per litre.
SCENE_SPEND = {"air": ("t", 1.497), "rail": ("t", 0.443), "taxi": ("t", 0.5047), "taxi_fuel": ("t", 0.8334), "taxi_ev": ("t", 0.4556), "public_transit": ("t", 0.443), "road": ("t", 0.5047), "waste": ("kg", 419.0), "hotel": ("t", 2.036)}
SCENE_LITRES = {"gasoline": (633.96, 0.75), "diesel": (650.86, 0.84)}
SCENE_HOTEL_NIGHT, SCENE_WATER = 66.52, 0.168
FREIGHT_RAIL, FREIGHT_AIR, FREIGHT_ROAD_DEFAULT, FREIGHT_LAST = 0.006502, 0.921, 0.2478, 0.2478
# Hotel cities in order, travel rate in CNY and factor in kg CO2e per night.
CITY_RATES = {"北京": 500, "上海": 500, "广州": 450, "深圳": 450, "杭州": 400, "南京": 380, "成都": 380, "武汉": 380, "西安": 350, "重庆": 380, "天津": 380, "苏州": 380, "宁波": 400, "青岛": 380, "厦门": 400, "长沙": 350, "郑州": 350, "济南": 380, "哈尔滨": 350, "沈阳": 350}
HOTEL_FACTORS = {"北京": 68.5, "上海": 65.2, "广州": 58.7, "深圳": 55.3, "杭州": 48.9, "南京": 45.6, "成都": 46.2, "武汉": 44.8, "西安": 42.5, "重庆": 45.0, "天津": 52.0, "苏州": 47.0, "宁波": 46.5, "青岛": 48.0, "厦门": 50.2, "长沙": 43.0, "郑州": 42.0, "济南": 46.0, "哈尔滨": 48.5, "沈阳": 47.5}
HOTEL_FACTOR_DEFAULT = 50.0
MODE_WORDS = [(["航空", "空运", "航班", "飞机", "货运航空"], "air"), (["铁路", "火车", "高铁", "动车", "货运专列"], "rail"), (["公路", "汽运", "货车", "卡车", "物流", "快递", "配送", "运输"], "road")]
# Road and water freight: product, name, kg CO2e per tonne kilometre.
ROAD_MODES = [
    ("65125X0012018C", "铁路（综合货运）", 0.008), ("65119X0082019C", "中型汽油货车运输(载重8t)", 0.115), ("65129X0022019C", "铁路运输(中国市场平均)", 0.01), ("65119X0172019C", "电力机车运输", 0.01), ("65117X0122019C", "内燃机车运输", 0.011),
    ("65212X0012019C", "液货船运输(载重 2000t)", 0.019), ("65119X0102019C", "重型汽油货车运输(载重18t)", 0.104), ("65119X0092019C", "重型汽油货车运输(载重10t)", 0.104), ("65119X0162019C", "重型柴油货车运输(载重46t)", 0.057), ("65229X0012019C", "干散货船运输(载重 2500t)", 0.015),
    ("65119X0142019C", "重型柴油货车运输(载重 18t)", 0.129), ("65119X0152019C", "重型柴油货车运输(载重 30t)", 0.078), ("65119X0112019C", "轻型柴油货车运输 (载重 2t)", 0.286), ("65119X0122019C", "中型柴油货车运输(载重8t)", 0.179), ("65119X0072019C", "轻型汽油货车运输(载重 2t)", 0.334),
    ("65119X0132019C", "重型柴油货车运输(载重 10t)", 0.162), ("43560X0012022C", "曳引式电梯", 27.18), ("49114X0012023C", "轻型冷藏车（柴油）", 0.5711), ("65119X0402024C", "纯电动货车运输-不区分质量区间", 0.1278), ("65119X0272024C", "柴油货车运输-不区分质量区间", 0.2157),
    ("65111X0052024C", "轻型冷链汽油货车运输", 0.2518), ("65111X0142024C", "微型冷链天然气货车运输", 0.9666), ("65111X0062024C", "微型冷链汽油货车运输", 0.7771), ("65111X0102024C", "微型冷链纯电动货车运输", 0.25), ("65119X0482024C", "微型天然气货车运输", 0.8405),
    ("65119X0392024C", "微型汽油货车运输", 0.6758), ("65119X0432024C", "微型纯电动货车运输", 0.2174), ("65119X0442024C", "天然气货车运输-不区分质量区间", 0.2478), ("65119X0412024C", "重型纯电动货车运输", 0.1073), ("65119X0292024C", "重型柴油货车运输 [25000kg,31000kg]", 0.0936),
    ("65119X0302024C", "重型柴油货车运输 [20000kg,25000kg]", 0.0972), ("65119X0312024C", "重型柴油货车运输 [16000kg,20000kg]", 0.1025), ("65119X0452024C", "重型天然气货车运输", 0.1088), ("65111X0072024C", "重型冷链纯电动货车运输", 0.1202), ("65111X0022024C", "重型冷链柴油货车运输", 0.1095),
    ("65111X0112024C", "重型冷链天然气货车运输", 0.1219), ("65119X0422024C", "轻型纯电动货车运输", 0.1361), ("65119X0382024C", "轻型汽油货车运输", 0.2248), ("65119X0362024C", "轻型柴油货车运输", 0.2611), ("65119X0472024C", "轻型天然气货车运输", 0.3013),
    ("65111X0092024C", "轻型冷链纯电动货车运输", 0.1524), ("65111X0042024C", "轻型冷链柴油货车运输", 0.2925), ("65111X0132024C", "轻型冷链天然气货车运输", 0.3374), ("65119X0282024C", "重型柴油货车运输", 0.0978), ("65139X0012024C", "中型纯电动货车运输", 0.1036),
    ("65219X0932024C", "沿海和远洋航运-均值", 0.006088), ("65219X0892024C", "沿海和远洋航运-其他液货船", 0.028775), ("65219X0912024C", "沿海和远洋航运-其他普通货船", 0.011719), ("65119X0342024C", "中型柴油货车运输 [8500kg,10500kg]", 0.1569), ("65119X0352024C", "中型柴油货车运输 [7000kg,8500kg]", 0.1493),
    ("65119X0332024C", "中型柴油货车运输 [10500kg,12500kg]", 0.1445), ("65119X0322024C", "中型柴油货车运输", 0.1502), ("65119X0372024C", "汽油货车运输-不区分质量区间", 0.2252), ("65119X0462024C", "中型天然气货车运输", 0.163), ("65111X0082024C", "中型冷链纯电动货车运输", 0.116),
    ("65111X0032024C", "中型冷链柴油货车运输", 0.1683), ("65111X0122024C", "中型冷链天然气货车运输", 0.1826), ("65229X0082024C", "内河水运-拖船", 0.006402), ("65213X0062024C", "沿海和远洋航运-集装箱船", 0.008122), ("65222X0012024C", "内河水运-油船", 0.014938),
    ("65229X0062024C", "内河水运-集装箱船", 0.004505), ("65219X0922024C", "沿海和远洋航运-多用途船", 0.009746), ("65219X0862024C", "沿海和远洋航运-干散货船", 0.005337), ("65219X0902024C", "沿海和远洋航运-杂货船", 0.015548), ("65229X0072024C", "内河水运-滚轮船", 0.002608),
    ("65219X0872024C", "沿海和远洋航运-油船", 0.004293), ("65219X0882024C", "沿海和远洋航运-液化气船", 0.049505), ("65229X0052024C", "内河水运-干散货船", 0.002134), ("65125X0022025C", "运输过程-铁路", 0.003), ("65319X0022025C", "运输过程-航空", 1.404),
    ("65229X0092025C", "运输过程-水路", 0.02), ("65117X0102025C", "运输过程-公路", 0.076),
]

# Industry dictionary, standard categories with aliases, categories 0 to 9.
DICTIONARY = {
    "能源类": ["成品油", "汽油", "柴油", "煤炭", "天然气", "燃料油", "液化气", "煤气", "电力", "热力"],
    "原材料类": ["钢材", "钢板", "水泥", "木材", "塑料", "铝材", "铜材", "橡胶", "玻璃", "涂料"],
    "运输类": ["运费", "物流", "快递", "运输服务", "配送", "货运", "仓储"],
    "办公类": ["办公用品", "纸张", "文具", "电脑", "打印机", "办公桌", "订书机", "复印纸", "文件夹", "笔"],
    "服务类": ["咨询", "劳务", "维修", "租赁", "技术服务", "设计", "检测", "安装"],
}
STANDARD_CATEGORIES = {
    "能源-成品油": ["成品油", "汽油", "柴油", "燃料油"], "能源-煤炭": ["煤炭", "原煤", "洗煤", "型煤"], "能源-天然气": ["天然气", "煤气", "液化气"], "原材料-钢材": ["钢材", "钢板", "钢带"], "原材料-水泥": ["水泥"], "原材料-木材": ["木材", "木料"], "原材料-塑料": ["塑料"],
    "运输-物流": ["运费", "物流", "快递", "运输服务", "配送", "货运"], "办公-用品": ["办公用品", "纸张", "文具", "订书机", "复印纸", "文件夹", "笔"], "办公-设备": ["电脑", "打印机", "复印机", "扫描仪"], "办公-家具": ["办公桌", "办公椅", "文件柜", "木制家具"],
    "服务-维修": ["维修", "维修费", "检修"], "服务-咨询": ["咨询", "劳务", "技术服务", "设计", "检测"], "服务-租赁": ["租赁", "租用"],
}
CATEGORY_LABELS = {0: "电子产品", 1: "办公家具", 2: "文具纸张", 3: "运输服务", 4: "维修服务", 5: "燃料能源", 6: "建筑材料", 7: "机械设备", 8: "食品饮料", 9: "其他"}
CATEGORY_PREFIXES = {"101": 5, "102": 5, "103": 5, "104": 5, "105": 5, "106": 5, "107": 5, "108": 5, "109": 5, "110": 5, "5": 5, "1": 5, "2": 5, "3": 5, "4": 5, "6": 8, "7": 7, "8": 9, "9": 9, "300": 9, "301": 9, "302": 9, "303": 9, "304": 9, "305": 9}
STANDARD_TO_CATEGORY = {"办公-设备": 0, "办公-家具": 1, "办公-用品": 2, "运输-物流": 3, "服务-维修": 4, "能源-成品油": 5, "能源-煤炭": 5, "能源-天然气": 5, "原材料-钢材": 6, "原材料-水泥": 6, "原材料-木材": 6, "原材料-塑料": 6, "服务-咨询": 9, "服务-租赁": 9}
# Materials of manufacturing: keywords, factor id or null, unit parts, confidence; and product energy: years, kWh a year.
MATERIALS = [
    (["微型电机", "微电机", "电机", "马达", "电动机"], "material_motor", ["个", "台", "件"], "高"),
    (["钢材", "钢板", "钢带", "冷轧", "热轧", "钢铁"], "material_steel", ["吨", "t", "kg", "千克"], "高"),
    (["水泥"], "eeio_cement", ["吨", "t", "kg"], "高"),
    (["塑料", "PVC", "PE", "PP", "ABS"], "material_plastic", ["吨", "t", "kg", "千克"], "中"),
    (["铜", "铜材", "铜线", "铜丝"], "material_copper", ["吨", "t", "kg", "千克"], "中"),
    (["铝", "铝材", "铝合金"], "material_aluminum", ["吨", "t", "kg", "千克"], "中"),
    (["电缆", "电线", "线缆"], None, ["米", "m", "千米", "km"], "中"),
]
PRODUCT_ENERGY = {"空调": (10, 800.0), "房间空调器": (10, 800.0), "冰箱": (12, 300.0), "电冰箱": (12, 300.0), "洗衣机": (10, 80.0), "电视机": (8, 150.0), "电视": (8, 150.0), "电脑": (5, 150.0), "计算机": (5, 150.0), "显示器": (5, 50.0), "打印机": (5, 30.0), "复印机": (5, 80.0), "饮水机": (5, 200.0), "热水器": (8, 600.0), "电热水器": (8, 600.0)}
ACTIVITY_UNITS = {"度": "kWh", "kWh": "kWh", "千瓦时": "kWh", "兆瓦时": "MWh", "MWh": "MWh", "吨": "t", "t": "t", "tons": "t", "升": "L", "L": "L", "立方米": "m3", "m3": "m3", "方": "m3", "GJ": "GJ"}

# Forms of names, certificates, tickets, products and tonne kilometres.
UNIT_CHARACTER = "^[元队型瓶个只支盒包袋箱桶罐条张本台件套号克升度块根卷组副双听粒]$"
UNIT_WORDS = ["kg", "g", "ml", "l", "pcs", "pc", "set", "box"]
SPEC_FORMS = ["规格", r"^[A-Za-z]?\d+(?:\.\d+)?[A-Za-z]*$", r"^\d+\s*\*\s*\d+", r"^\d+#\s*-\s*\d+\s*\*", r"\d+#\s*-\s*\d+\s*\*\s*\d+"]
WEIGHT_FORM = r"(?i)^\d+(?:\.\d+)?\s*(?:克|千克|g|kg|ml|L)$"
CERTIFICATE_WORDS = ["不动产", "产权", "浦字", "沪（", "㎡", "证号", "权证"]
CERTIFICATE_CUTS = ["沪（", "沪(", "浦字", "不动产", "产权", "㎡"]
CERTIFICATE_FORM = r"沪\s*[（(]\s*\d{4}\s*[)）]"
SPELLED_WORDS = {"shoudu": "capital", "guoji": "international", "jichang": "airport"}
AIRPORT_CODE = r"\b([A-Z]{3})\b"
AIRPORT_PAIRS = [
    r"(?s)(?:出发|起飞)\D{0,60}\b([A-Z]{3})\b.*?(?:到达|降落)\D{0,60}\b([A-Z]{3})\b",
    r"(?s)\bFROM\b\D{0,50}\b([A-Z]{3})\b.*?\bTO\b\D{0,50}\b([A-Z]{3})\b",
    r"([A-Z]{3})\s*[-–—/→>]+\s*([A-Z]{3})",
]
CABINS = [("头等舱", "first", "first"), ("商务舱", "business", "business"), ("高端经济舱", "premium", "premium_economy"), ("经济舱", "economy", "economy")]
PRODUCT_ID = r"(?i)(65\d{3}X\d{6}[0-9A-Z])"
TONNE_KM_DIRECT = [r"(\d+\.?\d*)\s*吨\s*公里", r"(\d+\.?\d*)\s*吨[-·]?公里"]
TONNE_KM_PRODUCT = [r"(\d+\.?\d*)\s*吨[^\d]{0,30}?(\d+\.?\d*)\s*公里", r"(?i)(\d+\.?\d*)\s*t\s*[x×*]\s*(\d+\.?\d*)\s*km"]


def scene_factor(key: str) -> float:
    """kg CO2e per CNY of a spend factor."""
    kind, value = SCENE_SPEND[key]
    return value * 0.1 if kind == "t" else value / 10000


def litre_factor(key: str) -> float:
    """kg CO2e per litre."""
    per_tonne, per_litre = SCENE_LITRES[key]
    return per_tonne * per_litre / 1000


def factor_rows() -> list[tuple]:
    """All matcher factors in list order: id, name, category, value, unit, region, year, type."""
    grid = [("electricity_national", "全国电网平均排放因子", "电力", GRID_NATIONAL, "kgCO2e/kWh", "全国", 2024, "物理因子")]
    grid += [(GRID_IDS[r], f"{r}区域电网排放因子", "电力", v, "kgCO2e/kWh", r, 2023, "物理因子") for r, v in GRID_REGIONS.items()]
    grid += [(f"electricity_province_{p}", f"{p}省级电力平均排放因子", "电力", v, "kgCO2e/kWh", p, 2023, "物理因子") for p, v in GRID_PROVINCES.items()]
    return grid + [(i, n, c, v, u, "全国", y, "EEIO因子" if c == "EEIO" else "物理因子") for i, n, c, _, v, u, y in MATCHER_FACTORS]
