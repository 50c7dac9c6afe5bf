"""Classification of files, questions and documents by ordered rules over their names, folders and texts."""
from pyspark.sql import functions as F

from studyloom.functions.rules import SUBJECTS, all_matches, first_match, has, lacks

# Categories of a library file, tried in this order (t = whole path, n = file name).
FILE_CATEGORIES = [
    ("时政", [has("t", r"时政合集|每日晨读")]),
    ("答题卡", [has("t", r"答题纸|答题卡")]),
    ("真题", [has("t", r"真题|珍题|试题"), has("t", r"国考|国家|四川|联考|省考"), has("n", r"20\d\d")]),
    ("题册", [has("t", r"千题|万题|刷题|必刷|5000题|题集|题本|题组|100题|套题|专项刷题|4600问|4000题|600题|速算|行测题目|行测/答案/")]),
    ("申论素材", [has("t", r"申论"), has("t", r"范文|素材|模板|金句|规范词|热点|话题|典故|论据|人物|公文|贺词|会议")]),
    ("常识积累", [has("t", r"常识|省情|时政|口诀")]),
    ("笔记讲义", [has("t", r"笔记|讲义|宝典|思维导图|导图|手册|技巧|总结|课|班|要点|公式|秒杀")]),
]

# Subject words of a title, and the group each leads to.
TITLE_SUBJECTS = [
    ("言语理解", r"言语|成语|实词|词语|高频.{0,4}词|逻辑填空|片段阅读|语句|阅读理解"),
    ("数量关系", r"数量|数学运算|数推|行程|工程问题|排列组合"),
    ("判断推理", r"判断|图形|图推|类比|定义|逻辑判断|翻译推理|削弱|加强"),
    ("资料分析", r"资料分析|资分|增长率|速算|^资料|【资料】"),
    ("常识判断", r"常识|政治|法律|历史|地理|科技|人文|时政|经济|马克思|党史|宪法|民法"),
]

# Words that tell the module of a question without a section heading, in this order.
CONTENT_WORDS = [
    ("言语理解与表达", r"填入(画|划)?横线|依次填入|这段文字|文段|意在|作者|主旨|标题|与原文|语句|排序|下一段|最恰当的一项|空缺处|衔接"),
    ("判断推理", r"如果为真|削弱|加强|支持|反驳|前提|假设|推出|能够得出|结论|定义|是指|逻辑关系|问号处|规律|图形|折叠|立体|类比|对应|"
              r"最为贴近|相似或接近|推理|说谎|真话|假话"),
]
DATA_WORDS = r"增长|同比|比重|百分点|%|亿元|万元|万人|万吨|倍"
COUNT_WORDS = r"多少|几(个|人|天|种|次|元|米|分钟|小时|岁|名|辆|台|块|位)|概率|至少|最多|最少|平均|百分之|[（(]\s*[）)]|？"
POLITICS_WORDS = r"习近平|总书记|党的|二十大|二十届|十九大|马克思|中国特色社会主义|新时代|全会|党中央|中共中央"


def base_name(path):
    return F.element_at(F.split(path, r"[/\\]"), -1)


def first_year(text):
    """First 20xx in the text, else 0."""
    y = F.regexp_extract(text, r"(20\d\d)", 1)
    return F.when(y == "", 0).otherwise(y.try_cast("int"))


def path_class(path, rules=FILE_CATEGORIES, exams=(("四川", r"四川"), ("国考", r"国考|国家")), subjects=SUBJECTS, default="其他"):
    """(category, subjects, exam, year) of a file, from its path and name."""
    t = F.translate(path, "\\", "/")
    cols = {"t": t, "n": base_name(t)}
    return (first_match(cols, rules, default).alias("cat"), all_matches(t, subjects).alias("subjects"),
            first_match(cols, [(n, [has("t", rx)]) for n, rx in exams]).alias("exam"), first_year(cols["n"]).alias("year"))


def two_level_group(title, path, cat, title_rules, path_rules, mixed, others):
    """(group, sub): the title decides when it names one subject, several make ``mixed``; then folders, then category.

    ``others`` are ordered rules over title (t), path (p) and category (c) tried before the folders.
    """
    named = all_matches(title, title_rules)
    folder = all_matches(path, path_rules)
    other = first_match({"t": title, "p": path, "c": cat}, others)
    sub = (F.when(F.size(named) == 1, named[0]).when(F.size(named) > 1, mixed).when(other != "", other)
           .when(F.size(folder) == 1, folder[0]).when(F.size(folder) > 1, mixed).otherwise(""))
    group = (F.when(F.size(named) > 0, "subject").when(other != "", "other").when(F.size(folder) > 0, "subject").otherwise("rest"))
    return group.alias("grp"), sub.alias("sub")


def content_module(stem, options, material, data_words=DATA_WORDS, words=CONTENT_WORDS, count_words=COUNT_WORDS,
                   politics=POLITICS_WORDS, labels=("资料分析", "数量关系", "政治理论", "常识判断")):
    """Module of a question from its words and digits; ``options`` is one string, ``material`` the shared text."""
    s = F.regexp_replace(F.coalesce(stem, F.lit("")), r"(?U)\s+", "")
    mat, opts = F.coalesce(material, F.lit("")), F.coalesce(options, F.lit(""))
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]"))
    case = F.when((mat != "") & F.concat(s, F.substring(mat, 1, 400)).rlike(data_words) & (digits(mat) > 20), labels[0])
    for label, rx in words:
        case = case.when(s.rlike(rx), label)
    counting = (digits(s) >= 2) & s.rlike(count_words) & F.when(opts != "", opts).otherwise(s).rlike("[0-9]")
    return case.when(counting, labels[1]).when(s.rlike(politics), labels[2]).otherwise(labels[3])


def date_parts(path, year_patterns, month_patterns, half_rules):
    """(year, month, half): from the file name, else from the folders, nearest first. Two-digit years mean 20xx."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    name = F.element_at(parts, -1)
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))

    def found(text, patterns):
        hits = [F.nullif(F.regexp_extract(text, rx, 1), F.lit("")).try_cast("int") for rx in patterns]
        return F.coalesce(*hits)

    def nearest(patterns):
        return F.get(F.filter(F.transform(folders, lambda f: found(f, patterns)), lambda x: x.isNotNull()), 0)

    y = F.coalesce(found(name, year_patterns), nearest(year_patterns), F.lit(0))
    m = F.coalesce(found(name, month_patterns), nearest(month_patterns), F.lit(0))
    return (F.when((y > 0) & (y < 100), y + 2000).otherwise(y).alias("year"), F.when(m.between(1, 12), m).otherwise(0).alias("month"),
            first_match({"n": name}, half_rules).alias("half"))


# Year, month and half-month marks of news file names.
YEAR_MARKS = [r"(20\d\d)\s*年", r"(?<![\d.])(20\d\d)\.\d{1,2}(?![\d.])", r"(?<!\d)(2\d)\s*年\s*\d", r"(20\d\d)"]
MONTH_MARKS = [r"20\d\d\s*时政热点\s*[:：]?\s*(\d{1,2})\s*月", r"20\d\d\s*年\s*(\d{1,2})\s*(?:月|时政)", r"(?<![\d.])20\d\d\.(\d{1,2})(?![\d.])",
               r"(?<![\d.–-])(\d{1,2})\s*月"]
HALF_RULES = [
    ("第一季度", [has("n", "第一季度")]), ("第二季度", [has("n", "第二季度")]), ("第三季度", [has("n", "第三季度")]), ("第四季度", [has("n", "第四季度")]),
    ("上", [has("n", r"[（(]\s*上\s*[）)]|[-－]\s*上(?!\S*下)|上半月|\d月上|月\s*时政上|上\s*讲义")]),
    ("下", [has("n", r"[（(]\s*下\s*[）)]|[-－]\s*下|下半月|\d月下|月\s*时政下|下\s*讲义")]),
]

# Where a news file goes, in order; labels starting with "skip:" keep it out (n = name, r = whole path).
NEWS_SECTIONS = [
    ("skip:copybook or errata", [has("n", r"默写|勘误|历年真题(?!成语)")]),
    ("skip:old issue", [has("r", r"文件夹只保存本期与上期")]),
    ("成语演练", [has("r", r"每日晨读"), has("n", r"随堂演练")]),
    ("skip:monthly bundle", [has("r", r"每日晨读"), has("r", r"成语积累"), has("n", r"合集")]),
    ("成语", [has("r", r"每日晨读"), has("r", r"成语积累"), has("n", r"逻辑成语|成语积累"), has("n", r"\d{1,2}\.\d{1,2}")]),
    ("人民日报精读", [has("r", r"每日晨读"), lacks("r", r"成语积累"), has("n", r"^\s*20\d\d\.\d{1,2}\.\d{1,2}|^\s*\d{1,2}日\s*[-－]|\d{1,2}月\d{1,2}日")]),
    ("skip:no date", [has("r", r"每日晨读"), lacks("r", r"成语积累")]),
    ("skip:other exam", [has("n", r"山东事业单位")]),
    ("时政专题", [has("n", r"押题作文|范文|基层话题素材")]),
    ("时政专题", [has("n", r"季度|早自习|前瞻课|时政知识合集|思维导图"), lacks("n", r"政府工作报告")]),
    ("月度时政", [has("n", r"\d{1,2}\s*月"), has("r", r"时政|热点|串讲|梳理|讲练|刷题|题目|答案"),
              lacks("n", r"一号文件|政府工作报告|全会|两会|新年贺词|经济工作会议|冲刺|核心|上半年|1-4月|\d{3,}题")]),
    ("时政题库", [has("n", r"\d{2,4}\s*题|题本|刷题本|题目|套卷|必刷|题库|押题"), lacks("n", r"讲义\s*\+\s*60题|时政\s*\+\s*刷题|刷题\s*[+（(]|讲练")]),
]


def doc_describe(path, rules=NEWS_SECTIONS, default="时政专题"):
    """(section, skip_reason) of a file; exactly one of them is set."""
    t = F.translate(path, "\\", "/")
    label = first_match({"r": t, "n": base_name(t)}, rules, default)
    skip = label.startswith("skip:")
    return (F.when(~skip, label).alias("section"), F.when(skip, F.substring(label, 6, 100)).alias("skip_reason"))
