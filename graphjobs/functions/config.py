"""Word lists and limits of the jobs, as parameters with defaults.

The default lists are fixed values: results depend on each of them and on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values ------------------------------------------------------------------

TERMS = (
    "立春", "雨水", "惊蛰", "春分", "清明", "谷雨", "立夏", "小满", "芒种", "夏至", "小暑", "大暑",
    "立秋", "处暑", "白露", "秋分", "寒露", "霜降", "立冬", "小雪", "大雪", "冬至", "小寒", "大寒",
)
UNKNOWN_SEASON = "未知"

SKIP_WORDS = (
    "作者", "通讯作者", "关键词", "文章编号", "中图分类号", "文献标识码", "文献标志码", "收稿日期",
    "修回日期", "出版日期", "基金项目", "引用格式", "第一作者", "通信作者", "版权", "出版社",
)
ABSTRACT_MARKS = ("摘要", "abstract", "【摘要】")
KEYWORD_MARKS = ("关键词", "key words", "【关键词】")
REFERENCE_MARKS = ("参考文献", "references", "[参考文献]")
RELEVANT_WORDS = ("二十四节气", *TERMS, "节气", "养生")
RELAXED_WORDS = ("宜吃", "调配", "保健", "少吃", "不能吃")

BLACKLIST = (
    "我们", "专家", "研究", "本文", "其中", "另外", "因此", "所以", "各种", "部分", "一些", "左右", "以上", "以下",
    "具有", "可以", "可能", "相关", "非常", "重要", "主要", "一般", "往往", "中医", "西医", "中国", "我国", "明显",
    "很多", "尤其", "但是", "而且", "这个", "那个",
)
#: Names of one character that stand.
SHORT_NAMES = (
    "金木水火土阴阳精气神风雨雷电露霜雪冰雾寒暑湿燥热凉暖温"
    "心肝脾肺肾胆胃肠头面口鼻耳目眼舌齿喉项背胸腹腰臀脐手臂指腿膝足脚身体肌肤皮肉骨筋脉血汗尿便痰津液"
    "葱姜蒜韭椒芹芥藕笋瓜茄豆芽苗叶根梨桃杏李梅枣栗柿橘柚鱼禽蛋奶虾蟹鳖龟粥汤饭茶酒饮醋盐糖蜜油酱"
    "谷麦黍稷稻粱米粮药毒仁草花果春夏秋冬年月日时季候旬晨午晚夜昼养营酸甜苦辣咸肥蔬狗鹰蝉獭禾桐菌人杨谭云外"
)
#: Names of one character that an entity dictionary keeps.
SHORT_DICTIONARY_NAMES = ("心", "肝", "脾", "肺", "肾", "胆", "胃", "肠", "春", "夏", "秋", "冬")

PERSON_RELATIONS = ("作者", "撰写", "参与", "参与研究", "主讲人", "提出", "提出者")
CREATION_RELATIONS = ("创建者", "创编", "创作", "发明")
SOURCE_RELATIONS = ("刊载", "发表期刊", "发表地点", "出版", "发布平台", "刊发内容", "出版周期", "出版时间")
SEASON_WORDS = ("春季", "夏季", "秋季", "冬季", "春天", "夏天", "秋天", "冬天", "季节", "时节")
TECHNIQUE_WORDS = ("导引", "功法", "气功", "坐功", "行功", "拳", "式", "八段锦", "导引术", "养生法", "功图", "功势", "太极")
FOOD_WORDS = ("汤", "粥", "茶", "酒", "菜", "果", "瓜", "豆", "米", "饭", "面", "肉", "鱼", "鸡", "鸭", "蜂蜜", "枣")
DISEASE_WORDS = ("病", "症", "炎", "癌", "中暑", "感冒", "高血压", "哮喘")
BODY_WORDS = (
    "心脏", "心", "肝", "脾", "胃", "肺", "肠", "头", "手", "足", "腰", "背", "鼻", "咽", "喉", "胸", "腹", "膝", "骨", "经", "穴", "脉",
)
ORGANISATION_WORDS = (
    "大学", "学院", "医院", "研究所", "中心", "机构", "委员会", "杂志社", "出版社", "临床", "附属", "实验室", "公司", "平台", "部门", "科",
)
SOURCE_WORDS = ("杂志", "期刊", "报", "出版社", "出版", "刊")
LOCATION_WORDS = (
    "市", "省", "区", "县", "镇", "村", "洲", "湾", "岭", "北京", "上海", "广州", "南京", "长春", "武汉", "成都", "中国",
    "广东", "江苏", "黑龙江", "青藏高原", "珠江三角洲", "华南", "华北", "江南", "岭南",
)
NO_PERSON_WORDS = ("气", "经", "穴", "病", "症", "血", "雨", "雪", "风", "节", "季")
#: Surnames of one character, in the order of the Hundred Family Surnames.
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳"
    "酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明计伏成戴谈宋茅庞熊"
    "纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁宣贲邓郁"
    "单杭洪包诸左石崔吉钮龚程嵇邢滑裴陆荣翁荀羊於惠甄魏家封芮羿储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁"
    "仇栾暴甘斜厉戎祖武符刘姜"
)
GENERIC_HEADS, GENERIC_TYPES = ("养生", "饮食", "方法", "措施"), ("包含", "属于", "包括", "涉及")

QUESTION_GROUPS = (
    ("节气", TERMS),
    ("脏腑", ("心", "肝", "脾", "肺", "肾", "胃", "胆", "小肠", "大肠", "膀胱", "三焦")),
    ("饮食", ("茶", "粥", "汤", "药膳", "食疗", "饮食", "进补", "滋补")),
    ("疾病", ("咳嗽", "感冒", "腹泻", "便秘", "失眠", "头痛", "风寒", "湿热")),
    ("养生", ("养生", "保健", "调理", "导引", "按摩", "针灸", "艾灸", "运动")),
    ("作息", ("睡", "睡眠", "失眠", "作息", "休息", "熬夜", "早睡", "晚睡", "午休", "睡好")),
    ("情志", ("情绪", "心情", "焦虑", "烦躁", "抑郁", "压力", "情志", "心烦", "烦闷", "放松", "安神")),
    ("运动", ("运动", "锻炼", "跑步", "散步", "拉伸", "太极", "八段锦", "气功", "瑜伽", "功法", "体操")),
)
RELATION_ASKED = ("关系", "联系", "关联", "区别", "路径")
ASKS_FOOD = ("吃", "食", "饮", "忌", "补", "膳", "菜", "药膳", "食疗")
ASKS_EMOTION = ("情绪", "心情", "焦虑", "烦躁", "抑郁", "压力", "情志", "心烦", "烦闷", "放松")
ASKS_EXERCISE = ("运动", "锻炼", "跑步", "散步", "拉伸", "太极", "八段锦", "气功", "瑜伽", "功法")
#: What else is asked, with a season in the question and without.
ASKS_REST = (("睡", "失眠", "作息", "休息", "熬夜", "早睡", "晚睡", "午休"), ("睡", "睡眠", "休息", "早睡", "晚睡", "午休", "规律", "调整", "起居"))
ASKS_DISEASE = (("病", "症", "治疗", "预防", "缓解"), ("病", "症", "治疗", "预防", "调理", "缓解"))
ASKS_HEALTH = ("养生", "保健", "方法", "注意")
INTENT_WORDS = {
    "饮食养生": ("宜食", "忌食", "饮", "食", "补", "汤", "茶", "粥", "药膳", "食疗"),
    "疾病调理": ("预防", "治疗", "缓解", "调理", "对应症状", "导致", "可能导致", "禁忌"),
    "节气养生": ("养生", "保健", "功效", "宜", "忌", "导引", "功法", "方法", "注意", "对应时节"),
    "起居作息": ("作息", "睡眠", "休息", "早睡", "熬夜", "规律", "调整", "起居"),
    "情志调理": ("情志", "情绪", "心神", "安神", "静心", "舒缓", "放松"),
    "运动调理": ("运动", "锻炼", "功法", "太极", "八段锦", "拉伸", "散步", "体操", "瑜伽"),
}
OTHER_INTENT_WORDS = ("养生", "功效", "宜", "忌", "调理", "导引")
FOOD_HINTS = ("汤", "粥", "菜", "芽", "肉", "鱼", "蛋", "粉", "饼", "卷", "豆", "食", "果", "青菜", "韭")
METHOD_HINTS = ("锻炼", "运动", "导引", "保健", "养生", "按摩", "功法", "起居", "注意")
#: Relation words that decide an answer's bucket, in order; the first that fits wins.
GOOD_RELATIONS = ("宜食", "宜", "适宜", "宜吃")
BAD_RELATIONS = ("忌食", "忌", "不宜")
EFFECT_RELATIONS = ("预防", "治疗", "缓解", "调理", "预防中暑")
CAUSE_RELATIONS = ("导致", "引起", "可致", "易引起")

# --- parameters --------------------------------------------------------------------


@dataclass(frozen=True)
class TextConfig:
    """What segmentation looks for. LATIN serves texts without CJK."""

    terms: tuple[str, ...] = TERMS
    skip_words: tuple[str, ...] = SKIP_WORDS
    abstract_marks: tuple[str, ...] = ABSTRACT_MARKS + KEYWORD_MARKS
    reference_marks: tuple[str, ...] = REFERENCE_MARKS
    relevant_words: tuple[str, ...] = RELEVANT_WORDS + RELAXED_WORDS
    #: Characters that make a text a real one, as a class, and how many it needs.
    script: str = r"[\x{4e00}-\x{9fff}]"
    min_script: int = 20
    min_chars: int = 30
    sentence_marks: str = "[。！？]"
    closing_marks: str = "。！？；："
    target: int = 80


LATIN = TextConfig(
    terms=("the ", "of ", "de ", "der "),
    skip_words=("licen", "http"),
    abstract_marks=("tion is", "estion"),
    reference_marks=("copyright", "all rights"),
    relevant_words=("th", "de", "en"),
    script="[A-Za-z]",
    sentence_marks="[.!?]",
    closing_marks=".!?;:",
)
