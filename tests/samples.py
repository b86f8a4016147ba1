"""Sample weekly rows: employee, tasks, response, after hours, sick, hours, accuracy, tone."""

HEADER = (
    "employee_name,tasks_completed,avg_response_time_hours,after_hours_logins,"
    "sick_days,weekly_hours,task_accuracy,sentiment"
)
WEEKS = {
    1: """Nora,12,0.8,0,0,44,90,Neutral
Ines,11,0.4,0,0,40,95,Positive
Oskar,15,0.6,1,0,37,99,Positive
Lena,10,0.5,1,0,39,93,Neutral
Tomas,12,1.2,1,0,41,90,Neutral
Greta,11,0.5,0,0,43,92,Neutral""",
    2: """Nora,11,1.1,0,0,42,92,Neutral
Ines,11,0.73,0,0,39,97,Neutral
Oskar,14,0.55,0,0,40,98,Positive
Lena,9,0.6,1,0,40,94,Neutral
Tomas,5,2.5,1,0,42,91,Neutral
Greta,12,0.6,0,0,44,95,Neutral""",
    3: """Nora,9,2.1,0,0,52,81,Negative
Ines,12,0.75,1,0,38,98,Neutral
Oskar,12,0.4,0,0,38,96,Neutral
Lena,11,0.55,0,0,37,97,Neutral
Tomas,5,3.5,2,1,38,86,Neutral
Greta,11,0.55,1,0,40,94,Positive""",
    4: """Nora,12,0.9,0,0,41,95,Positive
Ines,11,0.76,0,0,39,98,Neutral
Oskar,15,0.4,0,0,41,97,Positive
Lena,10,0.45,0,0,38,96,Positive
Tomas,2,3.9,1,1,37,83,Negative
Greta,10,0.4,1,0,38,99,Positive""",
}
CONFIRMED = [
    (3, "Ines", "Response Time Spike", (2, 3), "medium"),
    (3, "Tomas", "Declining Task Completion", (2, 3), "high"),
    (3, "Tomas", "Response Time Spike", (2, 3), "high"),
    (4, "Ines", "Response Time Spike", (2, 3, 4), "medium"),
    (4, "Tomas", "Declining Task Completion", (2, 3, 4), "high"),
    (4, "Tomas", "Response Time Spike", (2, 3, 4), "high"),
]


def write_weeks(folder):
    for week, text in WEEKS.items():
        (folder / f"week{week}.csv").write_text(HEADER + "\n" + text + "\n")
