"""Values that are part of the data contract: vocabularies, tables, formats and limits.

Everything here is a FIXED VALUE: it has to equal the established convention of the
trajectory data, otherwise results differ. Every operator takes these as default
arguments, so a deployment can pass its own.
"""

# --- fixed values: action space -------------------------------------------------
ACTION_TYPES = ("click", "left_double", "right_single", "drag", "scroll",
                "type", "hotkey", "wait", "finished", "call_user")

REQUIRED_FIELDS = {
    "click": ("point",), "left_double": ("point",), "right_single": ("point",),
    "drag": ("point", "point2"), "scroll": ("point", "direction"),
    "type": ("text",), "hotkey": ("text",),
    "wait": (), "finished": (), "call_user": (),
}

SCROLL_DIRECTIONS = ("up", "down", "left", "right")

ACTION_ALIASES = {
    "left_click": "click", "single_click": "click", "tap": "click",
    "double_click": "left_double", "left_double_click": "left_double",
    "right_click": "right_single",
    "type_text": "type", "input": "type",
    "key": "hotkey", "hotkeys": "hotkey", "press": "hotkey",
    "done": "finished", "finish": "finished", "complete": "finished",
    "ask_user": "call_user",
}

KEYBOARD_TYPES = ("type", "hotkey")
POINTED_TYPES = ("click", "left_double", "right_single", "scroll")
TERMINAL_TYPES = ("finished", "call_user")

PARSE_FAILED = "解析失败"          # predicted type of a step without a usable answer

# raw mouse action -> canonical type
MOUSE_ACTIONS = {"click": "click", "double_click": "left_double",
                 "scroll_up": "scroll", "scroll_down": "scroll"}
SCROLL_POINT = (0.5, 0.5)

# reasons counted when a raw action cannot be converted
REASON_NO_ASSET = "缺截图或分辨率"
REASON_NOT_OBJECT = "动作不是对象"
REASON_NO_POSITION = "mouse:缺坐标"
REASON_OUT_OF_BOUNDS = "mouse:坐标越界"
REASON_NO_TEXT = "keyboard:缺文本"
REASON_NO_KEY = "keyboard:缺键名"
REASON_BAD_KEY = "keyboard:键名无法解析"
REASON_OTHER = "其他"

# reasons counted when a grounding candidate is dropped, in the order they are tested
GROUNDING_REASONS = ("缺候选元素或截图", "bbox 解析失败", "目标框太小",
                     "没有元素描述", "目标框在图外", "裁剪后目标不在窗口内")

NEGATIVE_MARKERS = ("_neg_plan", "_neg_eval")

# --- fixed values: sub-task verdicts ---------------------------------------------
SUCCESS, RETRY, REFORMULATE = "sub_task_success", "need_retry", "need_reformulate"
SITUATIONS = (SUCCESS, RETRY, REFORMULATE)
SUBTASK_KEYS = ("element", "action", "subtask", "step", "description", "task", "content")
MAX_SUBTASKS = 8
MAX_REPLANS = 2

# --- fixed values: limits --------------------------------------------------------
MAX_STEPS = 15
MAX_ELEMENTS = 60
RESERVED_FOR_UNNAMED = 16
REPEAT_LIMIT = 3
RETRY_LIMIT = 2
STALL_LIMIT = 3
HISTORY_SHOWN = 5
TOKEN_BUDGET = 1360
ELEMENT_STEPS = (60, 45, 30, 20, 12, 6, 0)
TARGET_ELEMENTS_LIMIT = 40
VIEW_W, VIEW_H = 1280, 720
MIN_BOX_SIDE = 1
CV_MAX_ELEMENTS = 80
CV_DEDUP_IOU = 0.3
CV_TYPICAL_SIDE = 0.025
MIN_CONFIDENCE = 0.3
DIFF_THRESHOLD = 2.0
HIT_THRESHOLDS = (0.05, 0.10)
STEP_THRESHOLDS = (0.10, 0.14)
JOINT_DISTANCE = 0.10
MAJOR_SHARE = 0.10
THIN_SUPPORT = 15
CONFUSION_TOP = 15
WILSON_Z = 1.96
LEVELS = ("T1", "T2", "T3")
HEARTBEAT_MAX_AGE = 30.0
DESKTOP_PLATFORMS = ("windows", "macos")
COORD_SPACES = ("pixel", "rel1000", "original")

# --- fixed values: key names -----------------------------------------------------
KEY_ALIASES = {
    "control": "ctrl", "cmd": "win", "command": "win", "super": "win", "meta": "win",
    "return": "enter", "escape": "esc", "del": "delete", "pgup": "pageup", "pgdn": "pagedown",
    "winleft": "win", "winright": "win", "windows": "win", "lwin": "win", "rwin": "win",
    "lshift": "shift", "rshift": "shift", "lctrl": "ctrl", "rctrl": "ctrl",
    "lalt": "alt", "ralt": "alt", "ctrlleft": "ctrl", "ctrlright": "ctrl",
    "altleft": "alt", "altright": "alt", "shiftleft": "shift", "shiftright": "shift",
    "control_l": "ctrl", "control_r": "ctrl", "shift_l": "shift", "shift_r": "shift",
    "alt_l": "alt", "alt_r": "alt", "super_l": "win", "super_r": "win",
    "prior": "pageup", "next": "pagedown", "print": "printscreen",
}
X11_MODIFIERS = {"control": "ctrl", "ctrl": "ctrl", "alt": "alt", "shift": "shift",
                 "super": "win", "meta": "win", "win": "win"}        # each with _l and _r

# keys a keyboard backend can press: letters, digits and F-keys by rule, the rest by name
KNOWN_KEYS = (
    [chr(c) for c in range(ord("a"), ord("z") + 1)]
    + [str(d) for d in range(10)] + [f"f{n}" for n in range(1, 25)] + [f"num{d}" for d in range(10)]
    + list("!\"#$%&'()*,-./:;<=>?@[\\]^_`{|}~+")
    + ["ctrl", "alt", "shift", "win", "option", "fn", "enter", "esc", "tab", "space", "backspace",
       "delete", "insert", "home", "end", "pageup", "pagedown", "up", "down", "left", "right",
       "capslock", "numlock", "scrolllock", "printscreen", "prtsc", "pause", "apps", "help",
       "volumeup", "volumedown", "volumemute", "playpause", "nexttrack", "prevtrack",
       "browserback", "browserforward", "browserrefresh", "browserhome"]
)

# --- fixed values: content that is refused ---------------------------------------
BLOCKED_HOTKEYS = ("ctrl+alt+delete", "win+l")
BLOCKED_TEXT = (r"^format\s+[a-z]:", r"^rm\s+-[rf]{1,2}\b", r"^del\s+/[fsq]\b", r"^rd\s+/s\b",
                r"^shutdown\b", r"^diskpart\b", r"^mkfs\b")

# --- fixed values: application rules, tested in this order -----------------------
APP_RULES = (
    ("表格数据", ("_data table",)),
    ("图像编辑", ("gimp",)),
    ("终端与代码", ("command line", "terminal", "line of code")),
    ("游戏", ("game",)),
    ("系统工具", ("calculator", "event viewer", "disk management", "device manager", "partition",
              "rename a target txt")),
    ("办公文档", ("pdf", "slide", "presentation", "document", "paper size", "page number", "font",
              "text size", "table", "ruler", "underline", "bold", "text color", "insert a triangle")),
)
DEFAULT_APP = "浏览器与网页"

# --- fixed values: short text formats --------------------------------------------
ELEMENT_UNNAMED = "（图标，未识别出文字）"
ELEMENTS_EMPTY = "  （没有识别到文字元素）"
ELEMENT_FORMAT = "  [%s] %s  (位置 %s, %s)"      # both coordinates with two digits
HISTORY_EMPTY = "  （这是第一步）"
HISTORY_FORMAT = "  第%d步 %s → %s"
HISTORY_FAILED = "失败："
HISTORY_UNCHANGED = "执行了，但界面没有变化，很可能没点中"
HISTORY_OK = "成功"
STATUS_FAILED, STATUS_UNCHANGED, STATUS_CHANGED, STATUS_OK = "失败：", "界面无变化", "界面已变化", "ok"
SUBTASK_SUFFIX = "\n当前子任务："
SUBTASK_PATTERN = r"现在的子任务是\s*[“\"]?(.+?)[”\"]?\s*[。\n]"
LEAD_IN_PATTERN = r"[，。:：]?\s*(因此[，,]?)?下一步(的)?操作应该是[：:]?\s*$"

# --- fixed values: run-log file names --------------------------------------------
RUN_LOG_PREFIX, RUN_LOG_SUFFIX, RUN_LOG_CHANNELS = "tasks_", "_suite", ("live_", "vm_")

# default prompt templates of this package (placeholders in braces); pass your own table
PROMPT_TEMPLATES = {
    "base": "Task: {instruction}\n\nDone so far:\n{history}\n\nElements on screen:\n{elements}\n",
    "target": "Task: {instruction}\n\nDone so far:\n{history}\n\nName the control to operate.\n",
    "plan": "Task: {instruction}\n\nElements on screen:\n{elements}\n\nSplit it into at most {max_subtasks} steps.\n",
}

# How models spell numbers, boxes and points.
NUMBER_FORMAT = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
BOX_FORMATS = (
    r'"bbox_2d"\s*:\s*\[([^\]]+)\]',
    r"\((\d+),\s*(\d+)\),\s*\((\d+),\s*(\d+)\)",
    r"\[\s*([\d.]+\s*,\s*[\d.]+\s*,\s*[\d.]+\s*,\s*[\d.]+)\s*\]",
)
POINT_FORMATS = (
    r'"point"\s*:\s*\[([^\]]+)\]',
    r"\[\s*([\d.]+\s*,\s*[\d.]+)\s*\]",
)
