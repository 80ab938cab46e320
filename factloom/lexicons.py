"""Our own word lists; results of the readability rules depend on them. Pass other lists by replacing these names."""

# Fixed values.
EASY_WORDS = (
    "사람", "집", "돈", "물", "밥", "말", "글", "일", "날", "달", "해", "시간", "오늘", "내일", "어제", "아침", "저녁", "밤", "학교", "병원",
    "가족", "아이", "어른", "친구", "이름", "전화", "편지", "길", "차", "버스", "나라", "마을", "몸", "손", "발", "눈", "귀", "입", "옷", "책",
    "문", "방", "땅", "하늘", "나무", "꽃", "음식", "가게", "은행", "여러분",
)
HARD_TERMS = (
    "납부", "부과", "경감", "환급", "고지", "체납", "수급", "산정", "급여", "공제", "이의신청", "소급", "해지", "위임", "관할", "제출", "기재", "징수",
    "보험료", "세대주", "부양의무자", "소득인정액",
)
IDIOMS = ("발이 넓다", "손을 떼다", "눈 깜짝할 사이", "그림의 떡", "하늘의 별 따기", "발목을 잡다", "손꼽아 기다리다", "배가 아프다")
